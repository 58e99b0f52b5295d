"""Run state and progress: merging bookkeeping tables, folding the event log, history and rates."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablebridge.operators.merge import insert_new, upsert
from tablebridge.sources.shared import importable, stored

#: Weight of the newest value in a smoothed rate.
ALPHA = 0.3
#: Events of a run that one task folds, and a clock beyond all others.
BLOCK_ROWS, _ANY = 200_000, (1 << 63) - 1


def register_tables(registry: DataFrame, names: DataFrame) -> DataFrame:
    return insert_new(registry, names, ["project_id", "table_name"])


def update_registry(registry: DataFrame, results: DataFrame) -> DataFrame:
    """Upsert of a run's results by (project_id, table_name)."""
    return upsert(registry, results, ["project_id", "table_name"])


def update_progress(progress: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert by (migration_id, table_name); started_at keeps its first value."""
    return upsert(progress, updates, ["migration_id", "table_name"], keep_first=("started_at",))


def save_checkpoints(store: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert(store, rows, ["migration_id", "table_name", "batch_id"])


def last_checkpoint(store: DataFrame) -> DataFrame:
    """migration_id, table_name, batch_id, last_pk, rows_in_batch of each table's highest batch."""
    top = F.max_by(F.struct("last_pk", "rows_in_batch"), "batch_id")
    return store.groupBy("migration_id", "table_name").agg(F.max("batch_id").alias("batch_id"), top.alias("t")).select("migration_id", "table_name", "batch_id", "t.last_pk", "t.rows_in_batch")


def list_checkpoints(store: DataFrame, migration_id) -> DataFrame:
    return store.where(F.col("migration_id") == migration_id).orderBy("table_name", "batch_id")


def resume_points(progress: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """migration_id, table_name, mode (keyset or offset), start_offset, rows_done, last_key: a key token resumes by key from offset 0."""
    last = last_checkpoint(checkpoints).select("migration_id", "table_name", "last_pk")
    joined = progress.join(last, ["migration_id", "table_name"], "left")
    keyed = F.coalesce("last_pk", F.lit("")) != ""
    return joined.select("migration_id", "table_name", F.when(keyed, "keyset").otherwise("offset").alias("mode"), F.when(keyed, F.lit(0).cast("long")).otherwise(F.col("rows_transferred")).alias("start_offset"), F.col("rows_transferred").alias("rows_done"), F.when(keyed, F.col("last_pk")).alias("last_key"))


def pending_tables(tables: DataFrame, progress: DataFrame) -> DataFrame:
    return tables.join(progress.where("status = 'completed'").select("table_name"), "table_name", "left_anti")


def close_interrupted(runs: DataFrame, now: Column, message: str = "interrupted by restart") -> DataFrame:
    """Pending and running runs become failed."""
    open_ = F.col("status").isin("pending", "in_progress")
    return runs.withColumns({"status": F.when(open_, "failed").otherwise(F.col("status")), "error": F.when(open_, message).otherwise(F.col("error")), "completed_at": F.when(open_, now).otherwise(F.col("completed_at"))})


def set_status(runs: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """changes (id, new_status): in_progress stamps the start, an end the completion; cancelled has a fixed message."""
    joined = runs.join(changes, "id", "left")
    new = F.col("new_status")
    return joined.select(
        "id",
        F.coalesce(new, "status").alias("status"),
        F.when(new == "in_progress", now).otherwise(F.col("started_at")).alias("started_at"),
        F.when(new.isin("completed", "failed", "cancelled"), now).otherwise(F.col("completed_at")).alias("completed_at"),
        F.when(new == "cancelled", "cancelled by user").otherwise(F.col("error")).alias("error"),
    )


def active_runs(runs: DataFrame, statuses: tuple[str, ...] = ("pending", "in_progress")) -> DataFrame:
    return runs.where(F.col("status").isin(*statuses))


def run_history(runs: DataFrame, progress: DataFrame) -> DataFrame:
    """id, status, started_at, n_tables, tables (name=rows, by name) of each run, the newest first."""
    by = progress.groupBy(F.col("migration_id").alias("id")).agg(F.count("*").alias("n_tables"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "table_name", F.col("rows_transferred").cast("string")))), ",").alias("tables"))
    return runs.join(by, "id", "left").select("id", "status", "started_at", F.coalesce("n_tables", F.lit(0).cast("long")).alias("n_tables"), F.coalesce("tables", F.lit("")).alias("tables")).orderBy(F.desc("started_at"), F.desc("id"))


def purge_project(stores: dict[str, DataFrame], project_id: str) -> dict[str, DataFrame]:
    """Each store without a project: its own rows, and those of its runs (the store `runs` has id and project_id) in stores that know only runs."""
    gone = F.col("project_id").eqNullSafe(F.lit(project_id))
    by_run = purge_runs({n: df for n, df in stores.items() if "project_id" not in df.columns}, stores["runs"].where(gone).select("id"))
    return by_run | {n: df.where(~gone) for n, df in stores.items() if "project_id" in df.columns}


def purge_runs(stores: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Each store without the rows of the runs ids (id); a store names its run id or migration_id."""
    out = {}
    for name, df in stores.items():
        key = "migration_id" if "migration_id" in df.columns else "id"
        out[name] = df.join(ids.select(F.col("id").alias(key)), key, "left_anti")
    return out


def fold_tables(events: DataFrame) -> DataFrame:
    """run_id, table_name, status, rows_total, rows_transferred, error: the last state of each table in the log (run_id, table_name, seq, kind, rows_total, rows_transferred, error).

    A total is raised to what was transferred, and set to it when the table is done. A table that was only registered is
    pending, one that was only counted so far counting; counting never takes a later state back.
    """
    kind = F.col("kind")
    status = F.when(kind == "table_done", "done").when(kind == "table_failed", "failed").when(kind == "table_cancelled", "cancelled").when(kind.isin("batch", "table_started"), "in_progress")
    by = events.where("table_name IS NOT NULL").withColumn("status", status)
    last = by.groupBy("run_id", "table_name").agg(
        F.coalesce(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))), F.when(F.bool_or(kind == "counting"), "counting").otherwise("pending")).alias("status"),
        F.max_by("rows_total", F.when(F.col("rows_total").isNotNull(), F.col("seq"))).alias("total"),
        F.max_by("rows_transferred", F.when(F.col("rows_transferred").isNotNull(), F.col("seq"))).alias("rows_transferred"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("error"),
    )
    total = F.when(F.col("status") == "done", F.col("rows_transferred")).otherwise(F.greatest("total", "rows_transferred"))
    return last.select("run_id", "table_name", "status", total.alias("rows_total"), "rows_transferred", "error")


def fold_runs(tables: DataFrame) -> DataFrame:
    """run_id, rows_total, rows_transferred and the number of tables in each state, from fold_tables."""
    count = lambda s: F.count_if(F.col("status") == s)
    return tables.groupBy("run_id").agg(
        F.sum("rows_total").alias("rows_total"),
        F.sum("rows_transferred").alias("rows_transferred"),
        F.count("*").alias("tables_total"),
        count("done").alias("tables_done"),
        count("failed").alias("tables_failed"),
        count("cancelled").alias("tables_cancelled"),
        F.count_if(F.col("status").isin("in_progress", "counting")).alias("tables_in_progress"),
        count("pending").alias("tables_pending"),
    )


# The phase that an event starts.
PHASES = {
    "counting": "in_progress",
    "table_started": "in_progress",
    "resumed": "in_progress",
    "schema_phase": "schema",
    "post_schema_phase": "post_schema",
    "paused": "paused",
    "complete": "complete",
    "error": "failed",
    "cancelled": "cancelled",
}


def run_phase(events: DataFrame) -> DataFrame:
    """run_id, phase, current_table, error: the phase by the last event that sets one (pending before), the table last worked on ('' where the run ended), the last error of the run itself."""
    kind, seq = F.col("kind"), F.col("seq")
    phase = F.element_at(F.create_map(*(F.lit(x) for kv in PHASES.items() for x in kv)), kind)
    table = F.when(kind.isin("counting", "table_started", "batch"), F.col("table_name")).when(kind.isin("complete", "cancelled"), "")
    marked = events.select("run_id", "seq", "kind", "error", phase.alias("phase"), table.alias("current"))
    return marked.groupBy("run_id").agg(
        F.coalesce(F.max_by("phase", F.when(F.col("phase").isNotNull(), seq)), F.lit("pending")).alias("phase"),
        F.coalesce(F.max_by("current", F.when(F.col("current").isNotNull(), seq)), F.lit("")).alias("current_table"),
        F.max_by("error", F.when(kind == "error", seq)).alias("error"),
    )


def smoothed_rates(events: DataFrame, blocks: int | None = None) -> DataFrame:
    """run_id, read_rate, write_rate: rows a second of batches (seq, batch_rows, read_seconds, write_seconds), smoothed in order; zero durations are skipped.

    The log is dealt by ranges of (run, seq), into `blocks` of them if given, so a large run is folded by many tasks; each gives one affine step, and these are combined in order.
    """

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sorted rows (run_id, kind, x) the smoothing of each stretch of a run as one step: a becomes keep * a + add; seed is its first value."""
        part, names = TaskContext.get().partitionId(), ["run_id", "kind", "part", "keep", "add", "seed"]
        now, keep, add, seed, types = None, 1.0, 0.0, None, []

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            types, done = [batch.schema.field("run_id").type, pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()], []
            for run, kind, x in zip(*(batch.column(c).to_pylist() for c in ("run_id", "kind", "x")), strict=True):
                if now != (run, kind):
                    if now is not None:
                        done.append((*now, part, keep, add, seed))
                    now, keep, add, seed = (run, kind), 1.0, 0.0, None
                if x is not None:
                    seed = x if seed is None else seed
                    keep, add = (1 - ALPHA) * keep, ALPHA * x + (1 - ALPHA) * add
            if done:
                yield told(done)
        if now is not None:
            yield told([(*now, part, keep, add, seed)])

    rate = lambda c: F.col("batch_rows") / F.nullif(F.col(c).cast("double"), F.lit(0.0))
    kinds = F.array(*(F.struct(F.lit(i).alias("kind"), rate(c).cast("double").alias("x")) for i, c in enumerate(("read_seconds", "write_seconds"))))
    rows = events.where("batch_rows IS NOT NULL").select("run_id", "seq", F.explode(kinds).alias("r")).select("run_id", "r.kind", "seq", "r.x")
    by = ["run_id", "kind", "seq"]
    dealt = rows.repartitionByRange(blocks, *by) if blocks else rows.repartitionByRange(*by)
    steps = dealt.sortWithinPartitions(*by, "x").mapInArrow(folded, f"run_id {dict(rows.dtypes)['run_id']}, kind int, part int, keep double, add double, seed double")

    def combined(kind: int) -> Column:
        ordered = F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & F.col("seed").isNotNull(), F.struct("part", "keep", "add", "seed"))))
        return F.aggregate(ordered, F.lit(None).cast("double"), lambda a, s: s["keep"] * F.coalesce(a, s["seed"]) + s["add"])

    return steps.groupBy("run_id").agg(combined(0).alias("read_rate"), combined(1).alias("write_rate"))


def _next_sample(t: np.ndarray, reset: np.ndarray, least: int) -> np.ndarray:
    """For each event the first later one that is at least `least` after it or resets the clock; the length where there is none."""
    n = len(t)
    if (np.diff(t) >= 0).all():
        after = np.searchsorted(t, t + least, "left")
    else:
        # a clock that runs back: from the right, the events later than all between are kept, the latest first
        after, later = np.full(n, n), []
        for i in range(n - 1, -1, -1):
            far = bisect.bisect_right(later, -(t[i] + least), key=lambda j: -t[j])
            after[i] = later[far - 1] if far else n
            while later and t[later[-1]] <= t[i]:
                later.pop()
            later.append(i)
    places = np.nonzero(reset)[0]
    resets = np.append(places, n)[np.searchsorted(places, np.arange(n), "right")]
    return np.minimum(np.maximum(after, np.arange(n) + 1), resets)


class _Block:
    """Consecutive events of one run. Where a chain of samples enters it depends on the clock alone, where it leaves it on the entry."""

    def __init__(self, table: pa.Table, least: int):
        table = table.sort_by([("seq", "ascending"), ("t", "ascending"), ("rows", "ascending"), ("reset", "ascending")])
        self.t = table.column("t").to_numpy()
        self.reset = table.column("reset").to_numpy(zero_copy_only=False).astype(bool)
        self.rows = table.column("rows").to_pylist()
        self.least, self.n = least, len(self.t)
        self.next = _next_sample(self.t, self.reset, least)

    def first(self, at: int | None) -> int:
        """The first sample after a clock; without one, the first event."""
        if at is None:
            return 0
        hit = np.nonzero((self.t >= at + self.least) | self.reset)[0]
        return int(hit[0]) if len(hit) else self.n

    def known(self, i: int) -> float | None:
        """The rows last told at or before an event of the block."""
        while i >= 0 and self.rows[i] is None:
            i -= 1
        return self.rows[i] if i >= 0 else None

    def exits(self) -> list[tuple]:
        """(upto, at, done): for clocks up to `upto` (null: no clock yet; the greatest number: any) the last sample's time and rows. Clocks beyond all of them meet no sample here."""
        last = np.append(np.where(self.next < self.n, self.next, np.arange(self.n)), self.n)
        while (last[last] != last).any():
            last = last[last]  # each step doubles how far a pointer goes
        leave = lambda i: (int(self.t[last[i]]), self.known(int(last[i])))
        out = [(None, *leave(0))]
        records = np.nonzero(self.t > np.append(np.iinfo(np.int64).min, np.maximum.accumulate(self.t)[:-1]))[0]
        stop = np.nonzero(self.reset)[0]
        for i in records[records < stop[0]] if len(stop) else records:
            told = (int(self.t[i]) - self.least, *leave(i))
            if len(out) > 1 and out[-1][1:] == told[1:]:
                out.pop()
            out.append(told)
        return [*out, (_ANY, *leave(stop[0]))] if len(stop) else out

    def step(self, at: int | None, done: float | None, known: float | None) -> tuple[float, float, float | None]:
        """What the block does to a rate, given the last sample before it and the rows last told: keep * rate + add; seed is its first value."""
        keep, add, seed, i = 1.0, 0.0, None, self.first(at)
        while i < self.n:
            told = self.known(i)
            rows = known if told is None else told
            if at is not None and not self.reset[i] and (rows or 0.0) > (done or 0.0):
                x = ((rows or 0.0) - (done or 0.0)) * 1e6 / (int(self.t[i]) - at)
                seed = x if seed is None else seed
                keep, add = (1 - ALPHA) * keep, ALPHA * x + (1 - ALPHA) * add
            at, done, i = int(self.t[i]), rows, int(self.next[i])
        return keep, add, seed


def throughput(events: DataFrame, least_seconds: float = 1.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """run_id, rate: the rows since the last sample over its seconds, at most once in least_seconds, blended when rows came; the sample's clock always advances. A `resumed` event (kind, if there is such a column) sets it anew and gives no rate.

    Whether an event is a sample depends on the sample before. So the log (run_id, seq, ts, rows_done) is dealt into blocks
    of about block_rows events by (run, seq): each block tells, by the clock it is entered with, its last sample; a run's
    blocks, a few rows each, are walked in order; then each block folds its own samples. Events without a time, or without
    rows but for `resumed`, are no samples; a run without rate has 0.
    """
    importable(events.sparkSession)
    least = round(least_seconds * 1_000_000)
    reset = F.coalesce(F.col("kind") == "resumed", F.lit(False)) if "kind" in events.columns else F.lit(False)
    log = events.select("run_id", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("rows_done").cast("double").alias("rows"), reset.alias("reset")).where("t IS NOT NULL AND (reset OR rows IS NOT NULL)")
    kind = dict(log.dtypes)["run_id"]
    blocks = max(1, math.ceil(log.count() / block_rows))
    dealt = stored(log.repartitionByRange(blocks, "run_id", "seq").withColumn("block", F.spark_partition_id()), "log")
    by = ["run_id", "block"]

    def told(like: pa.Table, names: list[str], rows: list[tuple]) -> pa.Table:
        own = [like.column(c).slice(0, 1).combine_chunks().take(pa.array([0] * len(rows))) for c in by]
        return pa.table([*own, *(pa.array([r[i] for r in rows], pa.int64() if c in ("upto", "at") else pa.float64()) for i, c in enumerate(names))], names=[*by, *names])

    def exits(table: pa.Table) -> pa.Table:
        block = _Block(table, least)
        return told(table, ["upto", "at", "done", "known"], [(*e, block.known(block.n - 1)) for e in block.exits()])

    def walked(table: pa.Table) -> pa.Table:
        """The state in which each block of a run is entered."""
        at = done = known = None
        rows: dict[int, list[dict]] = {}
        for r in table.select(["block", "upto", "at", "done", "known"]).to_pylist():
            rows.setdefault(r["block"], []).append(r)
        entries = []
        for number in sorted(rows):
            entries.append((number, at, done, known))
            own = rows[number]
            fits = [r for r in own if (r["upto"] is None if at is None else r["upto"] is not None and at <= r["upto"])]
            if fits:
                best = min(fits, key=lambda r: r["upto"] or 0)
                at, done = best["at"], known if best["done"] is None else best["done"]
            known = known if own[0]["known"] is None else own[0]["known"]
        run = table.column("run_id").slice(0, 1).combine_chunks().take(pa.array([0] * len(entries)))
        return pa.table([run, *(pa.array([e[i] for e in entries], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.float64(), pa.float64())))], names=["run_id", "block", "at", "done", "known"])

    def folded(table: pa.Table, entry: pa.Table) -> pa.Table:
        e = entry.to_pylist()[0]
        return told(table, ["keep", "add", "seed"], [_Block(table, least).step(e["at"], e["done"], e["known"])])

    found = dealt.groupBy(*by).applyInArrow(exits, f"run_id {kind}, block int, upto long, at long, done double, known double")
    entries = found.groupBy("run_id").applyInArrow(walked, f"run_id {kind}, block int, at long, done double, known double")
    steps = dealt.groupBy(*by).cogroup(entries.groupBy(*by)).applyInArrow(folded, f"run_id {kind}, block int, keep double, add double, seed double")
    ordered = F.array_sort(F.collect_list(F.when(F.col("seed").isNotNull(), F.struct("block", "keep", "add", "seed"))))
    rate = F.aggregate(ordered, F.lit(None).cast("double"), lambda a, s: s["keep"] * F.coalesce(a, s["seed"]) + s["add"])
    runs = events.select("run_id").distinct()
    rates = steps.groupBy("run_id").agg(rate.alias("rate")).withColumnRenamed("run_id", "_run")
    return runs.join(rates, F.col("run_id").eqNullSafe(F.col("_run")), "left").select("run_id", F.coalesce("rate", F.lit(0.0)).alias("rate"))


def eta(snapshot: DataFrame) -> DataFrame:
    """snapshot (…, rate, idle_seconds, rows_total, rows_transferred, done) with eta_seconds: the rate decays after 3 idle seconds, to a tenth at least."""
    factor = F.when(F.col("idle_seconds") > 3, F.greatest(F.lit(0.1), 1 - (F.col("idle_seconds") - 3) / 12)).otherwise(1.0)
    rate = F.col("rate") * factor
    left = (F.col("rows_total") - F.col("rows_transferred")) / rate
    return snapshot.withColumn("eta_seconds", F.when(F.col("done") | (rate <= 0), 0.0).otherwise(left))


def stats_history(events: DataFrame, totals: DataFrame | None = None, every: str = "5 seconds", block: int = 4096) -> DataFrame:
    """run_id, snapshot_at, rows_transferred, rate, final: the rows moved until the end of each interval from a run's first event to its last, idle ones too, and the rows a second of that interval.

    A run that has ended (its log holds complete, error or cancelled) has one more snapshot, final, at its last event. With
    totals (run_id, rows_total) each snapshot has rows_total and percent, cut to a whole number, 0 where nothing is to be moved.
    Only intervals with events are summed up, a run's in blocks, so that a long run is no single task; the sum before a block
    and the start of the next one stand in front of its rows. Idle intervals are made last, row by row, and held nowhere.
    """
    spark, nothing = events.sparkSession, F.lit(None).cast("long")
    window, micros = F.window("ts", every), lambda c: F.unix_micros(c.cast("timestamp"))
    own = events.where("ts IS NOT NULL").select("run_id", window["end"].alias("snapshot_at"), (micros(window["end"]) - micros(window["start"])).alias("width"), F.coalesce("batch_rows", F.lit(0)).cast("long").alias("moved"))
    kind = dict(own.dtypes)["snapshot_at"]
    counted = own.groupBy("run_id", micros(F.col("snapshot_at")).alias("at")).agg(F.sum("moved").alias("moved"), F.max("width").alias("width"))
    counted = counted.withColumn("block", F.col("at") - F.pmod("at", F.col("width") * block))
    ended = F.bool_or(F.col("kind").isin("complete", "error", "cancelled"))
    finals = events.groupBy("run_id").agg(F.max("ts").cast(kind).alias("snapshot_at"), F.coalesce(F.sum("batch_rows"), F.lit(0)).cast("long").alias("rows_transferred"), ended.alias("ended"))
    finals = finals.where("ended").select("run_id", "snapshot_at", "rows_transferred", F.lit(0.0).alias("rate"), F.lit(True).alias("final"))
    blocks = Window.partitionBy("run_id").orderBy("block")
    before = F.sum("moved").over(blocks.rowsBetween(Window.unboundedPreceding, -1))
    carried = counted.groupBy("run_id", "block").agg(F.sum("moved").alias("moved"), F.min("at").alias("first"))
    carried = carried.select("run_id", "block", F.coalesce(before, F.lit(0)).cast("long").alias("moved"), F.lead("first").over(blocks).alias("next"))
    if totals is not None:
        carried, finals = (df.join(totals.select("run_id", "rows_total"), "run_id", "left") for df in (carried, finals))
    total = F.col("rows_total") if totals is not None else nothing
    both = counted.select("run_id", "block", "at", "moved", "width", nothing.alias("next"), nothing.alias("total")).union(carried.select("run_id", "block", nothing, "moved", nothing, "next", total))
    # a number of its own, since the little that is dealt here becomes many rows
    dealt = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "run_id", "block")
    inside = Window.partitionBy("run_id", "block").orderBy(F.asc_nulls_first("at"))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    after = F.coalesce(F.lead("at").over(inside), F.max("next").over(upto), F.col("at") + F.col("width"))
    summed = dealt.select("run_id", "at", "moved", "width", F.sum("moved").over(upto).alias("rows_transferred"), after.alias("after"), F.max("total").over(upto).alias("rows_total")).where("at IS NOT NULL")
    summed = summed.withColumn("stop", F.col("after") - F.col("width"))
    starts = summed.select("*", F.explode(F.sequence("at", "stop", F.col("width") * block)).alias("start"))
    filled = starts.select("*", F.explode(F.sequence("start", F.least(F.col("stop"), F.col("start") + F.col("width") * (block - 1)), "width")).alias("end"))
    rate = F.when(F.col("end") == F.col("at"), F.col("moved") * 1e6 / F.col("width")).otherwise(0.0)
    regular = filled.select("run_id", F.timestamp_micros("end").cast(kind).alias("snapshot_at"), "rows_transferred", rate.alias("rate"), F.lit(False).alias("final"), *(["rows_total"] if totals is not None else []))
    history = regular.union(finals)
    if totals is None:
        return history
    percent = F.when(F.col("rows_total") > 0, F.floor(F.col("rows_transferred") * 100 / F.col("rows_total"))).otherwise(0).cast("int")
    return history.withColumn("percent", percent)


def history_summary(history: DataFrame) -> DataFrame:
    """run_id, snapshots, first_at, last_at, seconds, final_rows, peak_rate of stats_history."""
    last = F.when(F.bool_or("final"), F.max_by("rows_transferred", F.when(F.col("final"), F.col("snapshot_at")))).otherwise(F.max_by("rows_transferred", "snapshot_at"))
    by = history.groupBy("run_id").agg(F.count("*").alias("snapshots"), F.min("snapshot_at").alias("first_at"), F.max("snapshot_at").alias("last_at"), last.alias("final_rows"), F.max("rate").alias("peak_rate"))
    return by.withColumn("seconds", F.unix_timestamp("last_at") - F.unix_timestamp("first_at"))


def project_status(tables: DataFrame, registry: DataFrame, run_id) -> DataFrame:
    """A run's tables, and the registry's others as pending with no rows where another run left them; by name."""
    own = tables.where(F.col("run_id") == run_id).select("table_name", "status", "rows_total", "rows_transferred")
    rest = registry.join(own.select("table_name"), "table_name", "left_anti")
    foreign = ~F.col("last_migration_id").eqNullSafe(F.lit(run_id))
    rest = rest.select("table_name", F.when(foreign, "pending").otherwise(F.col("status")).alias("status"), "rows_total", F.when(foreign, F.lit(0).cast("long")).otherwise(F.col("rows_transferred")).alias("rows_transferred"))
    return own.unionByName(rest).orderBy("table_name")


def project_totals(status: DataFrame) -> DataFrame:
    """tables, rows_total, rows_transferred over all tables of project_status."""
    zero = F.lit(0).cast("long")
    return status.agg(F.count("*").alias("tables"), F.coalesce(F.sum("rows_total"), zero).alias("rows_total"), F.coalesce(F.sum("rows_transferred"), zero).alias("rows_transferred"))


# Class of an error by the first rule of which it holds, as written, all texts of one group.
FAILURES = [
    ("missing_database", [["does not exist", "3D000"], ["does not exist", "database"]]),
    ("ssl", [["pg_hba.conf"], ["SSL off"]]),
    ("auth", [["authentication failed"], ["password authentication"]]),
    ("refused", [["connection refused"]]),
    ("hostname", [["no such host"], ["hostname"]]),
    ("timeout", [["i/o timeout"], ["context deadline"]]),
]


def failure_class(error: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, groups in FAILURES:
        out = out.when(reduce(or_, (reduce(and_, (error.contains(p) for p in group)) for group in groups)), name)
    return out.otherwise("other")


def classify_failures(errors: DataFrame) -> DataFrame:
    """hint, n of errors (error)."""
    return errors.groupBy(failure_class(F.col("error")).alias("hint")).agg(F.count("*").alias("n"))


def redacted(text: Column) -> Column:
    """A connection string without its user and password.

    In document and Postgres URIs all between the scheme and the first @ goes, whatever it holds; in other texts all before the last @. Without an @ nothing changes.
    """
    uri = r"(?s)^((?:mongodb(?:\+srv)?|postgres(?:ql)?)://)"
    return F.when(text.rlike(uri), F.regexp_replace(text, uri + "[^@]*@", "$1***:***@")).otherwise(F.regexp_replace(text, "(?s)^.*@", "***:***@"))


def redact_credentials(df: DataFrame, columns: list[str], passwords: list[str] = ()) -> DataFrame:
    hidden = {c: F.when(F.coalesce(c, F.lit("")) != "", "***").otherwise(F.col(c)) for c in passwords}
    return df.withColumns({c: redacted(F.col(c)) for c in columns} | hidden)
