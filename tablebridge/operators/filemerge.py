"""An upsert into a folder of Parquet files that rewrites only the files that hold the keys."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablebridge.operators.merge import align, last_by_key, upsert
from tablebridge.sources.shared import drop, exists, listed, move, read_state, stored, write_state

#: Bytes of a file that a merge aims at, and keys that may be broadcast.
FILE_BYTES, BROADCAST_KEYS = 128 << 20, 1_000_000
_STAGE = "_merge-"


def write_files(df: DataFrame, path: str, keys: list[str], files: int) -> None:
    """A new folder of files that each hold one range of the keys, so that a later merge finds few of them."""
    df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.parquet(path)


def recover(spark: SparkSession, path: str) -> None:
    """Finish a merge that was cut off after its journal was written, and drop what one left that was cut off before."""
    for name, stage, _ in listed(spark, path):
        if name.startswith(_STAGE):
            if exists(spark, f"{stage}/journal.json"):
                _swap(spark, path, stage, read_state(spark, f"{stage}/journal.json"))
            else:
                drop(spark, stage)


def _swap(spark: SparkSession, path: str, stage: str, journal: dict) -> None:
    """New files in, old files out; each step may have been done already."""
    for staged, name in journal["new"]:
        if exists(spark, f"{stage}/{staged}"):
            move(spark, f"{stage}/{staged}", f"{path}/{name}")
    for name in journal["old"]:
        drop(spark, f"{path}/{name}")
    drop(spark, stage)


def files_with_keys(target: DataFrame, wanted: DataFrame, keys: list[str]) -> list[str]:
    """Names of the files of a target that hold one of the wanted keys. Only key columns are read, and only in the range of the wanted first key, which the file statistics cut."""
    first = keys[0]
    low, high = wanted.agg(F.min(first), F.max(first)).first()
    held = target.select(*keys, F.col("_metadata.file_path").alias("_file"))
    if low is not None:
        held = held.where((F.col(first) >= F.lit(low)) & (F.col(first) <= F.lit(high)))
    few = wanted.select(*keys)
    few = F.broadcast(few) if few.count() <= BROADCAST_KEYS else few
    # one name a file: no more than the driver lists anyway
    return sorted(unquote(r[0].rsplit("/", 1)[1]) for r in held.join(few, keys, "left_semi").select("_file").distinct().collect())


def merge_files(spark: SparkSession, path: str, source: DataFrame, keys: list[str], order_by: str | None = None, keep_first: tuple[str, ...] = (), file_bytes: int = FILE_BYTES) -> dict[str, int]:
    """upsert() of source into the Parquet files of a flat folder: files, rewritten and written tell how many there were, were replaced, and are new.

    Files without a key of the source stay as they are; the others are read whole, merged and written anew by ranges of the keys.
    New files are staged in the folder and named in a journal before anything changes, so a merge that is cut off is either undone
    or finished by the next one (or by recover()). Between the two a reader may see a key twice; there may be one writer at a time.
    A source row with a null in a key is added (one of those with equal keys), an empty source changes nothing.
    """
    recover(spark, path)
    own = stored(last_by_key(source, keys, order_by), "delta")
    there = {name: size for name, _, size in listed(spark, path) if not name.startswith(("_", "."))}
    told = {"files": len(there), "rewritten": 0, "written": 0}
    if own.isEmpty():
        return told
    target = spark.read.parquet(path)
    touched = files_with_keys(target, own, keys) if there else []
    if touched:
        rows = upsert(spark.read.schema(target.schema).parquet(*(f"{path}/{name}" for name in touched)), own, keys, keep_first=keep_first)
    else:
        rows = align(own, target.schema)
    size = sum(there[name] for name in touched) + sum(size for f in own.inputFiles()[:1] for _, _, size in listed(spark, f.rsplit("/", 1)[0]))
    return told | {"rewritten": len(touched), "written": _exchange(spark, path, touched, lambda stage: write_files(rows, stage, keys, max(1, math.ceil(size / file_bytes))))}


def _exchange(spark: SparkSession, path: str, old: list[str], write: Callable[[str], None]) -> int:
    """Put what `write` writes into a staging folder in the place of the old files; the number of new ones."""
    stage = f"{path}/{_STAGE}{uuid.uuid4().hex}"
    write(stage)
    new = [name for name, _, _ in listed(spark, stage) if not name.startswith(("_", "."))]
    journal = {"old": old, "new": [[name, f"part-{uuid.uuid4().hex}.parquet"] for name in new]}
    write_state(spark, f"{stage}/journal.json", journal)
    _swap(spark, path, stage, journal)
    return len(new)


def replace_files(spark: SparkSession, path: str, rows: DataFrame) -> dict[str, int]:
    """A flat folder's files give way to those of `rows`, in their schema: a reload that empties or makes the table anew.

    The old rows stay until the new ones are all written, so that a load that fails loses nothing, and rows may be read from
    the folder itself; then the files are exchanged as in merge_files().
    """
    recover(spark, path)
    old = [name for name, _, _ in listed(spark, path) if not name.startswith(("_", "."))]
    return {"files": len(old), "rewritten": len(old), "written": _exchange(spark, path, old, lambda stage: rows.write.parquet(stage))}
