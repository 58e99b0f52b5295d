"""A streaming source over a table that grows by its key: the offset is the last key read, a micro-batch the keys after it.

The table is a folder of Parquet files. A batch is cut into key ranges at the ends of row groups, one a task; a task reads only
row groups whose statistics meet its range, so what was read before is not read again, however many files there are.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from tablebridge.sources.shared import importable, listed, read_text


def key_token(key: object) -> str:
    """The text of a key, as offsets keep it; empty for none."""
    return "" if key is None else key.isoformat() if isinstance(key, (datetime.date, datetime.datetime)) else str(key)


def token_key(token: str, kind: pa.DataType) -> object:
    """The key of a token; None where the token is empty."""
    if token == "":
        return None
    if pa.types.is_integer(kind):
        return int(token)
    if pa.types.is_timestamp(kind):
        return datetime.datetime.fromisoformat(token)
    return datetime.date.fromisoformat(token) if pa.types.is_date(kind) else token


class KeyRange(InputPartition):
    """Keys after `low` (null: from the first) up to `high`, as tokens."""

    def __init__(self, low: str, high: str):
        super().__init__((low, high))
        self.low, self.high = low, high


class KeysetTable:
    """The Parquet files under a path that Python can open, and their keys."""

    def __init__(self, path: str, key: str):
        files, place = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
        self.data, self.key = ds.dataset(place, filesystem=files, format="parquet", exclude_invalid_files=False), key
        self.kind = self.data.schema.field(key).type

    def tops(self, low: object) -> list:
        """The greatest keys of the row groups that hold keys after low, ascending; from statistics alone where files have them."""
        found = set()
        for fragment in self.data.get_fragments(filter=None if low is None else pc.field(self.key) > pa.scalar(low, self.kind)):
            for group in fragment.row_groups:
                own = group.statistics.get(self.key) if group.statistics else None
                if own is None or own.get("max") is None:
                    column = fragment.subset(row_group_ids=[group.id]).to_table(columns=[self.key])[self.key]
                    own = {"max": pc.max(column).as_py()}
                if own["max"] is not None and (low is None or own["max"] > low):
                    found.add(own["max"])
        return sorted(found)

    def ranges(self, low: str, high: str, parts: int) -> list[KeyRange]:
        """At most `parts` ranges that cover the keys after low up to high."""
        if low == high or high == "":
            return []
        start, end = token_key(low, self.kind), token_key(high, self.kind)
        cuts = [k for k in self.tops(start) if k < end]
        cuts = [cuts[i * len(cuts) // parts] for i in range(1, parts)] if len(cuts) >= parts else cuts
        ends = [low, *map(key_token, sorted(set(cuts))), high]
        return [KeyRange(a, b) for a, b in zip(ends, ends[1:], strict=False)]

    def read(self, part: KeyRange, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        key, low = pc.field(self.key), token_key(part.low, self.kind)
        wanted = key <= pa.scalar(token_key(part.high, self.kind), self.kind)
        if low is not None:
            wanted = wanted & (key > pa.scalar(low, self.kind))
        for batch in self.data.to_batches(columns=schema.names, filter=wanted):
            if batch.num_rows:
                yield batch.cast(schema)


class _Reader:
    def __init__(self, options: dict, schema: StructType):
        self.path, self.key = options["path"], options["key"]
        self.after, self.parts = options.get("after", ""), int(options.get("partitions", "8"))
        self.schema = to_arrow_schema(schema)

    @property
    def table(self) -> KeysetTable:
        return KeysetTable(self.path, self.key)

    def read(self, partition: KeyRange | None) -> Iterator[pa.RecordBatch]:
        # a read without ranges is one of None
        return self.table.read(partition, self.schema) if partition else iter(())


class KeysetReader(_Reader, DataSourceReader):
    def partitions(self) -> list[KeyRange]:
        table = self.table
        tops = table.tops(token_key(self.after, table.kind))
        return table.ranges(self.after, key_token(tops[-1]), self.parts) if tops else []


class KeysetStreamReader(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"key": self.after}

    def latestOffset(self) -> dict:
        tops = self.table.tops(None)
        return {"key": key_token(tops[-1]) if tops else self.after}

    def partitions(self, start: dict, end: dict) -> list[KeyRange]:
        return self.table.ranges(start["key"], end["key"], self.parts)


class KeysetSource(DataSource):
    """Format `keyset`. Options: path, key (an integer, text, date or timestamp column that grows), after (a token to begin behind), partitions."""

    @classmethod
    def name(cls) -> str:
        return "keyset"

    def schema(self) -> StructType:
        return from_arrow_schema(KeysetTable(self.options["path"], self.options["key"]).data.schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return KeysetReader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return KeysetStreamReader(self.options, schema)


def _options(spark: SparkSession, path: str, key: str, after: str, partitions: int) -> dict:
    importable(spark)
    spark.dataSource.register(KeysetSource)
    return {"path": path, "key": key, "after": after, "partitions": str(partitions)}


def read_keyset(spark: SparkSession, path: str, key: str, after: str = "", partitions: int = 8) -> DataFrame:
    """The rows whose key is after a token; rows of null key are never read."""
    return spark.read.format("keyset").options(**_options(spark, path, key, after, partitions)).load()


def stream_keyset(spark: SparkSession, path: str, key: str, after: str = "", partitions: int = 8) -> DataFrame:
    """A stream of the rows of a growing table. A restart under the same checkpoint goes on behind the last key read, another one begins behind `after`.

    Keys must grow: a row that comes later with a key that was passed is not read, nor is one of null key.
    """
    return spark.readStream.format("keyset").options(**_options(spark, path, key, after, partitions)).load()


def last_token(spark: SparkSession, checkpoint: str) -> str:
    """The token of the last batch that a stream over one keyset source has finished; empty where there is none."""
    done = [int(n) for n, _, _ in listed(spark, f"{checkpoint}/commits") if n.isdigit()]
    if not done:
        return ""
    return json.loads(read_text(spark, f"{checkpoint}/offsets/{max(done)}").splitlines()[-1])["key"]
