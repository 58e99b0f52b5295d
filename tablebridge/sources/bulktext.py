"""Bulk text as a source and a sink: tab-separated lines, special characters behind a backslash, \\N for null.

A write is all or nothing: each task writes one file into a staging folder, and only when all tasks have ended are the files
moved to their place. A write that fails leaves what was there before; a task of it that is killed late may leave a hidden
folder `_bulk-...`, which no reader looks into.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tablebridge.operators.merge import bulk_text_line
from tablebridge.sources.shared import importable

#: Lines of a batch that the reader gives on.
LINES = 4096
_FIELD = re.compile(rb"((?:[^\t\\]|\\.)*)(?:\t|\Z)", re.S)  # the last match is the empty one at the end
_ESCAPED = re.compile(rb"\\(.)", re.S)


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def _files(files: pyarrow.fs.FileSystem, folder: str) -> list[str]:
    found = files.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


def fields(line: bytes) -> list[bytes | None]:
    """The values of a line without its end."""
    if b"\\" not in line:
        return line.split(b"\t")
    return [None if x == b"\\N" else _ESCAPED.sub(rb"\1", x) for x in _FIELD.findall(line + b"\t")[:-1]]


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class BulkTextWriter(DataSourceArrowWriter):
    """Rows of one column, `line`."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.stage = path.rstrip("/"), overwrite, f"_bulk-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = _place(self.path)
        name, rows, out = f"part-{uuid.uuid4().hex}.txt", 0, None
        try:
            for batch in iterator:
                if batch.num_rows:
                    if out is None:
                        files.create_dir(f"{folder}/{self.stage}", recursive=True)
                        out = files.open_output_stream(f"{folder}/{self.stage}/{name}")
                    out.write(b"".join(line + b"\n" for line in batch.column("line").to_pylist()))
                    rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(name if rows else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = _place(self.path)
        files.create_dir(folder, recursive=True)
        old = _files(files, folder) if self.overwrite else []
        for m in messages:
            if m and m.name:
                files.move(f"{folder}/{self.stage}/{m.name}", f"{folder}/{m.name}")
        for path in old:
            files.delete_file(path)
        self._clear(files, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_place(self.path))

    def _clear(self, files: pyarrow.fs.FileSystem, folder: str) -> None:
        """Drop the staging folder, with files of attempts that did not count."""
        if files.get_file_info(f"{folder}/{self.stage}").type != pyarrow.fs.FileType.NotFound:
            files.delete_dir(f"{folder}/{self.stage}")


class BulkTextReader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in _files(*_place(self.path))]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        rows: list[list[bytes | None]] = []
        with _place(self.path)[0].open_input_stream(partition.value) as stream:
            for line in _lines(stream):
                rows.append(fields(line))
                if len(rows) == LINES:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[list[bytes | None]]) -> pa.RecordBatch:
        for row in rows:
            if len(row) != len(self.names):
                raise ValueError(f"a line has {len(row)} values for {len(self.names)} columns")
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], self.names)


def _lines(stream: pa.NativeFile, size: int = 1 << 20) -> Iterator[bytes]:
    """Lines without their ends; an end behind an odd number of backslashes belongs to its line."""
    rest, held = b"", b""
    while chunk := stream.read(size):
        *whole, rest = (rest + chunk).split(b"\n")
        for line in whole:
            held += line
            if (len(line) - len(line.rstrip(b"\\"))) % 2:
                held += b"\n"
            else:
                yield held
                held = b""
    if held or rest:
        yield held + rest


class BulkTextSource(DataSource):
    """Format `bulktext`; option path. Written are rows of a binary column `line`, read are binary columns by the order of their names."""

    @classmethod
    def name(cls) -> str:
        return "bulktext"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return BulkTextReader(self.options["path"], schema.names)

    def writer(self, schema: T.StructType, overwrite: bool) -> BulkTextWriter:
        return BulkTextWriter(self.options["path"], overwrite)


def write_bulk_text(df: DataFrame, path: str, mode: str = "append") -> None:
    """df as bulk text under a path that Python workers can open: one file a task, none unless all tasks end. Mode overwrite drops the files before it only then."""
    importable(df.sparkSession)
    df.sparkSession.dataSource.register(BulkTextSource)
    bulk_text_line(df).select(F.col("line").cast("binary").alias("line")).write.format("bulktext").mode(mode).save(path)


def read_bulk_text(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of write_bulk_text() in the columns and types of a schema."""
    importable(spark)
    spark.dataSource.register(BulkTextSource)
    names = sorted(schema.names)
    raw = spark.read.format("bulktext").schema(T.StructType([T.StructField(n, T.BinaryType()) for n in names])).load(path)
    return raw.select(*((F.col(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name).cast("string").cast(f.dataType)).alias(f.name) for f in schema))
