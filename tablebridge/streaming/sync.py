"""Streaming forms: resumable copies, plans over streams, live progress and rates, windowed snapshots, replay removal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tablebridge.operators.runs import ALPHA
from tablebridge.sources.shared import drop, read_state, versions
from tablebridge.streaming.versioned import WIDTH, VersionedTable


def read_stream(spark: SparkSession, folder: str, name: str, schema: StructType, files: int = 1) -> DataFrame:
    """A stream of the Parquet files called name in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files).parquet(folder)


def _run(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> None:
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_sync(stream: DataFrame, start: DataFrame, target: str, keys: list[str], checkpoint: str, order_by: str, width: int = WIDTH) -> DataFrame:
    """The target after the stream: of every key the row of greatest order_by, be it of the start, of this stream or of an earlier one.

    Each micro-batch is one commit of a VersionedTable, at the cost of its own size. A batch that was committed before is
    skipped: a stream is known by the id in its checkpoint, so another checkpoint, also one made anew at the same place, adds to
    what is there. Versions of one key may come in any order, in one batch or in many; of equal order_by the later batch counts,
    null is the oldest. A row with a null in a key meets no row of the start and is added. Columns that only the start has keep their value.
    One stream may write at a time; a second one fails at its commit.
    """
    spark, table = start.sparkSession, VersionedTable(start.sparkSession, target)
    table.create(start, keys, order_by)

    def step(batch: DataFrame, i: int) -> None:
        table.add(batch, read_state(spark, f"{checkpoint}/metadata")["id"], i, width)

    _run(stream, step, checkpoint, "append")
    return table.read()


def stream_append(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """A stateless stream into Parquet files."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)


def stream_state(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """The complete state of a streaming aggregate, rewritten after each micro-batch; a restart without new rows gives the state of before, no rows at all an empty one."""
    spark = stream.sparkSession

    def step(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/stream_version={i}")
        for old in versions(spark, target):
            if old < i:
                drop(spark, f"{target}/stream_version={old}")

    _run(stream, step, checkpoint, "complete")
    found = versions(spark, target)
    return spark.read.parquet(f"{target}/stream_version={found[-1]}") if found else spark.createDataFrame([], stream.schema)


def progress(events: DataFrame) -> DataFrame:
    """run_id, table_name, rows_transferred, last_seq so far."""
    return events.groupBy("run_id", "table_name").agg(F.sum("batch_rows").alias("rows_transferred"), F.max("seq").alias("last_seq"))


def stream_rates(events: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """run_id, read_rate, write_rate of a stream of batches, smoothed in the order of seq inside each micro-batch; a run's state is its two rates.

    Micro-batches are taken to come in order, as a log written in order gives them. Each commits the new rates of its runs to a
    VersionedTable, which keeps few folders; of a run the newest count.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rates = list(state.get) if state.exists else [None, None]
        rows = pd.concat(batches).sort_values("seq")
        for i, column in enumerate(("read_seconds", "write_seconds")):
            x = (rows["batch_rows"] / rows[column].where(rows[column] != 0)).dropna().to_numpy()
            if len(x):
                # each value weighs (1 - ALPHA) less than the next; the first of all is the seed
                old = x[0] if rates[i] is None else rates[i]
                fade = (1 - ALPHA) ** np.arange(len(x) - 1, -1, -1)
                rates[i] = float((1 - ALPHA) ** len(x) * old + ALPHA * (fade * x).sum())
        state.update(tuple(rates))
        yield pd.DataFrame({"run_id": [key[0]], "read_rate": [rates[0]], "write_rate": [rates[1]]}, dtype=None)

    kind = f"run_id {dict(events.dtypes)['run_id']}, read_rate double, write_rate double"
    rows = events.select("run_id", "seq", F.col("batch_rows").cast("double").alias("batch_rows"), F.col("read_seconds").cast("double").alias("read_seconds"), F.col("write_seconds").cast("double").alias("write_seconds"))
    found = rows.groupBy("run_id").applyInPandasWithState(fold, kind, "read_rate double, write_rate double", "update", GroupStateTimeout.NoTimeout)
    spark, table = events.sparkSession, VersionedTable(events.sparkSession, target)
    table.create(spark.createDataFrame([], kind), ["run_id"], "version")

    def step(batch: DataFrame, i: int) -> None:
        table.add(batch.withColumn("version", F.lit(i).cast("long")), read_state(spark, f"{checkpoint}/metadata")["id"], i)

    _run(found, step, checkpoint, "update")
    return table.read()


def stats_windows(events: DataFrame, every: str = "5 seconds", delay: str = "1 minute") -> DataFrame:
    """window_end, rows: tumbling windows; later events than the watermark are dropped in append mode."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", every)).agg(F.sum("batch_rows").alias("rows")).select(F.col("window.end").alias("window_end"), "rows")


def dedup(events: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
