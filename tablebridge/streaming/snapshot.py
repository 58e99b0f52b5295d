"""The live state of runs: totals, phase, rate and time left, kept per run while its events stream in, and fading while none come."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tablebridge.operators.runs import ALPHA, PHASES
from tablebridge.sources.shared import importable, read_state
from tablebridge.streaming.versioned import VersionedTable

#: Milliseconds after which a run without events is told again, and those from which on it counts as idle.
AGAIN_MS, IDLE_MS = 1000, 3000
#: Microseconds between two samples of a rate.
SAMPLE = 1_000_000
_COLUMNS = "phase string, current_table string, tables_total long, tables_done long, tables_failed long, rows_total long, rows_transferred long, rate double, idle_seconds double, eta_seconds double, error string, told_at long"
# The state of a table that an event gives it, and the events that end a run.
_STATUS = {"table_done": "done", "table_failed": "failed", "table_cancelled": "cancelled", "batch": "in_progress", "table_started": "in_progress"}
_ENDS = ("complete", "error", "cancelled")


def _or_none(x):
    return None if pd.isna(x) else x


class RunState(StatefulProcessor):
    """State of one run: a value for the run, a map of its tables. It goes when the run ends. Without `idle` no timers are set."""

    def __init__(self, idle: bool):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "phase string, current string, error string, at long, done long, rate double, seen long")
        self.tables = handle.getMapState("tables", "table_name string", "status string, counting boolean, total long, rows long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle else int(time.time() * 1000)
        phase, current, error, at, done, rate, _ = self.run.get() if self.run.exists() else ("pending", "", None, None, 0, 0.0, now)
        tables = {k[0]: list(v) for k, v in self.tables.iterator()}
        changed, moved, ended = set(), sum(t[3] or 0 for t in tables.values()), False
        for e in pd.concat(rows).sort_values("seq").itertuples():
            kind, name = e.kind, _or_none(e.table_name)
            if name is not None:
                own = tables.setdefault(name, [None, False, None, None])
                changed.add(name)
                own[0], own[1] = _STATUS.get(kind, own[0]), own[1] or kind == "counting"
                own[2] = own[2] if pd.isna(e.rows_total) else int(e.rows_total)
                if not pd.isna(e.rows_transferred):
                    moved += int(e.rows_transferred) - (own[3] or 0)
                    own[3] = int(e.rows_transferred)
            phase = PHASES.get(kind, phase)
            current = name if kind in ("counting", "table_started", "batch") and name is not None else "" if kind in ("complete", "cancelled") else current
            error = _or_none(e.error) if kind == "error" else error
            ended = ended or kind in _ENDS
            t = None if pd.isna(e.t) else int(e.t)
            if t is not None and (at is None or kind == "resumed" or t - at >= SAMPLE):
                if at is not None and kind != "resumed" and moved > done:
                    new = (moved - done) * 1e6 / (t - at)
                    rate = new if rate == 0 else ALPHA * new + (1 - ALPHA) * rate
                at, done = t, moved
        out = self._told(key, phase, current, error, rate, tables, now, now, ended)
        for timer in list(self.handle.listTimers()) if self.idle else ():
            self.handle.deleteTimer(timer)
        if ended:
            self.run.clear()
            self.tables.clear()
        else:
            for name in changed:
                self.tables.updateValue((name,), tuple(tables[name]))
            self.run.update((phase, current, error, at, done, rate, now))
            if self.idle:
                self.handle.registerTimer(now + AGAIN_MS)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        phase, current, error, _, _, rate, seen = self.run.get()
        self.handle.registerTimer(now + AGAIN_MS)
        yield self._told(key, phase, current, error, rate, {k[0]: list(v) for k, v in self.tables.iterator()}, now, seen, False)

    def _told(self, key, phase, current, error, rate, tables, now, seen, ended) -> pd.DataFrame:
        total, moved = 0, sum(t[3] or 0 for t in tables.values())
        for status, _, of, rows in tables.values():
            total += (rows or 0) if status == "done" else max(of or 0, rows or 0)
        idle = now - seen
        # the rate fades from three idle seconds on, to a tenth at least
        shown = rate * max(0.1, 1 - (idle - IDLE_MS) / 12_000) if idle > IDLE_MS else rate
        left = (total - moved) / shown if shown > 0 and total > moved and not ended else 0.0
        count = lambda s: sum(t[0] == s for t in tables.values())
        return pd.DataFrame([[key[0], phase, current, len(tables), count("done"), count("failed"), total, moved, shown, idle / 1000, left, error, now]], columns=["run_id", *(c.split()[0] for c in _COLUMNS.split(", "))])


def run_snapshots(events: DataFrame, idle: bool = True) -> DataFrame:
    """A stream of snapshots: one of every run in each micro-batch that has events of it, and, with idle, one a second or so while it has none.

    events is a stream of (run_id, seq, ts, kind, table_name, rows_total, rows_transferred, error), the log of fold_tables();
    a micro-batch is applied in the order of seq, and micro-batches as they come. The state of a run is one value and
    one entry a table, and is dropped when the run ends. A query over it needs RocksDB state (see live_snapshots()).
    """
    importable(events.sparkSession)
    rows = events.select("run_id", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "kind", "table_name", F.col("rows_total").cast("long").alias("rows_total"), F.col("rows_transferred").cast("long").alias("rows_transferred"), "error")
    return rows.groupBy("run_id").transformWithStateInPandas(RunState(idle), f"run_id {dict(rows.dtypes)['run_id']}, {_COLUMNS}", "Update", "processingTime" if idle else "none")


def live_snapshots(events: DataFrame, target: str, checkpoint: str, seconds: float = 0, every: str = "1 second") -> DataFrame:
    """The newest snapshot of each run, kept in a VersionedTable: after all events there are, or after `seconds` of waiting for more."""
    spark: SparkSession = events.sparkSession
    # timers keep a query busy for ever, so one that ends with its events has none
    found, table = run_snapshots(events, idle=seconds > 0), VersionedTable(spark, target)
    table.create(spark.createDataFrame([], found.schema), ["run_id"], "told_at")

    def step(batch: DataFrame, i: int) -> None:
        batch.persist()
        if not batch.isEmpty():
            table.add(batch, read_state(spark, f"{checkpoint}/metadata")["id"], i)
        batch.unpersist()

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = found.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).outputMode("update")
        if seconds:
            query = writer.trigger(processingTime=every).start()
            end = time.time() + seconds
            while query.isActive and time.time() < end:
                query.awaitTermination(0.5)
            query.stop()
        else:
            query = writer.trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return table.read()
