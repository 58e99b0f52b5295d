"""The folder that driver and executors share: tables written there, who owns them, and small state files."""

from __future__ import annotations

import atexit
import json
import os
import tempfile
import uuid
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder, but only for a local master (tests): a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Stored paths that no scope owns; they go when the process ends.
_unowned: list[tuple[SparkSession, str]] = []


class Scope:
    """Owns what stored() writes inside `with`, in this thread. release() drops it; what is left at the end goes to the scope around it, or stays until the process ends."""

    _now: ContextVar[Scope | None] = ContextVar("scope", default=None)

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> Scope:
        self._token = Scope._now.set(self)
        return self

    def __exit__(self, *error) -> None:
        Scope._now.reset(self._token)
        outer = Scope._now.get()
        (_unowned if outer is None else outer.paths).extend(self.paths)
        self.paths = []

    def release(self, *kept: DataFrame) -> None:
        """Drop all paths that none of `kept` reads."""
        files = [f for df in kept for f in df.inputFiles()]
        used = [(s, p) for s, p in self.paths if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in files)]
        for spark, path in self.paths:
            if (spark, path) not in used:
                drop(spark, path)
        self.paths = used


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: the lineage ends there and lost executors cost no recomputation."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    scope = Scope._now.get()
    (_unowned if scope is None else scope.paths).append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _drop_unowned() -> None:
    for spark, path in _unowned:
        try:
            drop(spark, path)
        except Exception:  # the session has ended already; the folder's owner clears what is left
            return


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def drop(spark: SparkSession, path: str) -> None:
    fs, target = _file_system(spark, path)
    fs.delete(target, True)


def listed(spark: SparkSession, path: str) -> list[tuple[str, str, int]]:
    """(name, full path, bytes) of what lies in a folder, by name; nothing where there is none."""
    fs, target = _file_system(spark, path)
    if not fs.exists(target):
        return []
    return sorted((s.getPath().getName(), s.getPath().toString(), s.getLen()) for s in fs.listStatus(target))


def move(spark: SparkSession, source: str, to: str) -> None:
    fs, target = _file_system(spark, source)
    if not fs.rename(target, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"cannot move {source} to {to}")


def write_state(spark: SparkSession, path: str, state: dict) -> None:
    """A new small JSON file, whole or not there at all; an error where it is there already."""
    fs, target = _file_system(spark, path)
    half = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.half")
    out = fs.create(half, False)
    out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(half, target):
        fs.delete(half, False)
        raise FileExistsError(f"{path} was written by another run")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    fs, target = _file_system(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def read_state(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def importable(spark: SparkSession) -> None:
    """Python workers find this package, also those that are started in another folder."""
    home, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if home not in (paths := env.get("PYTHONPATH", "").split(os.pathsep)):
        env["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers i of the finished writes `path`/stream_version=i, ascending."""
    names = [n for n, _, _ in listed(spark, path)]
    done = [n for n in names if n.startswith("stream_version=") and exists(spark, f"{path}/{n}/_SUCCESS")]
    return sorted(int(n.partition("=")[2]) for n in done)
