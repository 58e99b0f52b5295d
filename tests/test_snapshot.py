"""Live snapshots of runs against the folds over the whole log."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablebridge.operators import runs
from tablebridge.streaming import snapshot
from tablebridge.streaming import sync as streaming

KIND = "run_id long, seq long, t long, kind string, table_name string, rows_total long, rows_transferred long, error string"


def log_of(rng, run, n, end):
    t, moved, out = 1_700_000_000_000_000, dict.fromkeys("abc", 0), [(run, 0, 1_700_000_000_000_000, "counting", "a", 500, None, None), (run, 1, 1_700_000_000_000_000, "registered", "d", None, None, None)]
    for i in range(2, n):
        t += rng.choice([100_000, 900_000, 2_500_000])
        name = rng.choice("abc")
        if rng.random() < 0.1:
            out.append((run, i, t, rng.choice(["paused", "resumed", "schema_phase"]), None, None, None, None))
        else:
            moved[name] += rng.randrange(40)
            kind = rng.choice(["batch"] * 5 + ["table_done", "table_failed"])
            out.append((run, i, t, kind, name, 300, moved[name], "boom" if kind == "table_failed" else None))
    return out + ([(run, n, t, end, None, None, None, "lost" if end == "error" else None)] if end else [])


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(9)
    rows = [r for run, n, end in ((1, 80, None), (2, 40, "complete"), (3, 60, "error"), (4, 5, None)) for r in log_of(rng, run, n, end)]
    return spark.createDataFrame(rows, KIND).withColumn("ts", F.timestamp_micros("t")).drop("t")


def test_snapshots_are_those_of_the_whole_log(spark, log, tmp_path):
    for i, part in enumerate((log.where("seq < 20"), log.where("seq >= 20 AND seq < 45"), log.where("seq >= 45"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    out = []
    for i in range(3):  # one part after the other, with a restart between
        stream = streaming.read_stream(spark, f"{tmp_path}/in/[0-{i}]", "*.parquet", log.schema)
        out = snapshot.live_snapshots(stream, f"{tmp_path}/target", f"{tmp_path}/cp").collect()
    got = {r["run_id"]: r for r in out}
    tables = runs.fold_tables(log)
    totals = {r["run_id"]: r for r in runs.fold_runs(tables).collect()}
    phases = {r["run_id"]: r for r in runs.run_phase(log).collect()}
    before = F.lag("rows_transferred").over(Window.partitionBy("run_id", "table_name").orderBy("seq"))
    step = F.coalesce(F.col("rows_transferred") - F.coalesce(before, F.lit(0)), F.lit(0))
    by = F.sum("d").over(Window.partitionBy("run_id").orderBy("seq"))
    rates = {r["run_id"]: r["rate"] for r in runs.throughput(log.withColumn("d", step).withColumn("rows_done", by)).collect()}
    assert got.keys() == {1, 2, 3, 4}
    for run, r in got.items():
        t, p = totals[run], phases[run]
        assert (r["phase"], r["current_table"], r["error"]) == (p["phase"], p["current_table"], p["error"])
        assert (r["rows_transferred"], r["tables_total"], r["tables_done"], r["tables_failed"]) == (t["rows_transferred"], t["tables_total"], t["tables_done"], t["tables_failed"])
        assert r["rows_total"] == t["rows_total"] and r["rate"] == pytest.approx(rates[run], rel=1e-9)
        left = (r["rows_total"] - r["rows_transferred"]) / r["rate"] if run in (1, 4) and r["rate"] and r["rows_total"] > r["rows_transferred"] else 0
        assert r["eta_seconds"] == pytest.approx(left)


def test_an_idle_run_fades_without_events(spark, tmp_path):
    rows = [(1, i, 1_700_000_000_000_000 + i * 1_000_000, "batch", "a", 1000, i * 10, None) for i in range(10)] + [(2, 1, 1_700_000_000_000_000, "complete", None, None, None, None)]
    log = spark.createDataFrame(rows, KIND).withColumn("ts", F.timestamp_micros("t")).drop("t")
    log.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streaming.read_stream(spark, f"{tmp_path}/in", "*.parquet", log.schema)
    got = {r["run_id"]: r for r in snapshot.live_snapshots(stream, f"{tmp_path}/target", f"{tmp_path}/cp", seconds=25, every="500 milliseconds").collect()}
    idle = got[1]["idle_seconds"]
    assert idle > 3.5 and got[1]["rate"] == pytest.approx(10 * max(0.1, 1 - (idle - 3) / 12))
    assert got[1]["eta_seconds"] == pytest.approx(910 / got[1]["rate"])
    assert got[2]["phase"] == "complete" and got[2]["idle_seconds"] == 0
