"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablebridge.sources.shared import importable, stored  # noqa: F401

#: A text row is about 4 KB and may be far longer: small Arrow batches keep a Python worker's memory bounded.
BATCH_ROWS = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of few rows, for operators whose rows hold whole texts; Python workers started from another folder find this package too."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if `df` has at most `rows` rows (counted), else `df` as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fold(column: str, n: int):
    """crc32 of the column as text, modulo n; null for a null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


#: A key is hot if it has so many rows, and a thousandth of all: so there are a thousand hot keys at most. Tasks that share a hot key's rows.
HOT_ROWS, HOT_SHARE, SALTS = 1_000, 1_000, 64


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> list:
    """The hot keys of a table of `total` rows, given its rows by key (key, n); at most HOT_SHARE of them."""
    return [r[0] for r in counts.where(F.col(n) >= max(HOT_ROWS, total / HOT_SHARE)).select(key).collect()]


def split_join(left: DataFrame, right: DataFrame, key: str, spread: str, hot: list | None = None) -> DataFrame:
    """Inner join of left with right, which has one row a key; the rows of hot keys of left are shared among SALTS tasks by the column `spread`, and right's rows for them repeated."""
    hot = hot_keys(left.groupBy(key).count(), key, "count", left.count()) if hot is None else hot
    if not hot:
        return left.join(right, key)
    is_hot = F.col(key).isin(hot)
    salted = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0))
    repeated = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(repeated, [key, "_salt"]).drop("_salt")
