"""Targets that keep versions: streams into a table of commits, and merges that rewrite single files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tablebridge.operators import filemerge, merge
from tablebridge.sources import shared
from tablebridge.streaming import sync as streaming
from tablebridge.streaming.versioned import VersionedTable

KIND = "id long, v string, at long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def synced(spark, tmp_path):
    """Appends a file of rows to a stream's folder, runs the stream under a checkpoint, and gives the target's rows."""
    start = spark.createDataFrame([(i, "old", 0) for i in range(4)], KIND)

    def run(new, checkpoint="c1", folder="in", width=16, start=start):
        if new:
            spark.createDataFrame(new, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{folder}")
        stream = streaming.read_stream(spark, f"{tmp_path}/{folder}", "*.parquet", start.schema)
        return {r["id"]: r["v"] for r in streaming.stream_sync(stream, start, f"{tmp_path}/target", ["id"], f"{tmp_path}/{checkpoint}", "at", width).collect()}

    run.table = VersionedTable(spark, f"{tmp_path}/target")
    return run


OLD = dict.fromkeys(range(4), "old")


def test_a_restart_goes_on(synced):
    assert synced([(1, "a", 1), (7, "a", 1)]) == OLD | {1: "a", 7: "a"}
    assert synced([]) == OLD | {1: "a", 7: "a"}
    assert synced([(1, "b", 2)]) == OLD | {1: "b", 7: "a"}
    synced.table.compact()
    assert synced.table.state()["deltas"] == [] and synced([]) == OLD | {1: "b", 7: "a"}
    assert synced([(7, "c", 3), (1, "late", 1)]) == OLD | {1: "b", 7: "c"}  # the base has a newer version of 1


def test_a_second_checkpoint_adds_to_the_first(synced):
    synced([(1, "a", 1), (2, "a", 1)], "c1", "in1")
    synced.table.compact()
    assert synced([(5, "b", 1), (2, "b", 2)], "c2", "in2") == OLD | {1: "a", 2: "b", 5: "b"}
    assert synced([(6, "c", 1)], "c1", "in1") == OLD | {1: "a", 2: "b", 5: "b", 6: "c"}
    assert set(synced.table.state()["batches"].values()) == {0, 1}


def test_a_checkpoint_made_anew_is_another_stream(synced, tmp_path):
    synced([(1, "a", 1)])
    os.rename(tmp_path / "c1", tmp_path / "gone")
    assert synced([(8, "b", 1)]) == OLD | {1: "a", 8: "b"}


def test_the_newest_of_many_versions_counts(synced):
    versions = [(k, f"v{i}", i) for i in range(2000) for k in (0, 1, 9)]
    random.Random(1).shuffle(versions)
    assert synced(versions) == OLD | {0: "v1999", 1: "v1999", 9: "v1999"}
    assert synced([(0, "late", 1998), (1, "tie", 1999), (9, "none", None)]) == OLD | {0: "v1999", 1: "tie", 9: "v1999"}


def test_batches_leave_few_deltas_and_no_stray_files(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t")
    table.create(spark.createDataFrame([(0, "old", 0)], KIND), ["id"], "at")
    for i in range(40):
        assert table.add(spark.createDataFrame([(i % 7, f"b{i}", i)], KIND).coalesce(1), "w", i, width=3)
    assert not table.add(spark.createDataFrame([(0, "again", 99)], KIND), "w", 39, width=3)
    state = table.state()
    assert len(state["deltas"]) <= 2 * 4 and state["batches"] == {"w": 39}
    assert {r["id"]: r["v"] for r in table.read().collect()} == {k: f"b{max(i for i in range(40) if i % 7 == k)}" for k in range(7)}
    assert len(os.listdir(tmp_path / "t/data")) <= len(state["deltas"]) + 1 + 2 * 3
    assert len([n for n in os.listdir(tmp_path / "t/state") if n.endswith(".json")]) == 3


def test_two_writers_cannot_make_one_commit(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t")
    table.create(spark.createDataFrame([(0, "old", 0)], KIND), ["id"], "at")
    seen = table.state()
    table.add(spark.createDataFrame([(1, "a", 1)], KIND), "one", 0)
    with pytest.raises(FileExistsError):
        table._commit(seen)


def test_order_outside_the_target_and_columns_it_keeps(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t")
    table.create(spark.createDataFrame([(0, "old", "own"), (None, "n", "own")], "id long, v string, own string"), ["id"], "at")
    for i, new in enumerate(([(0, "b", 2), (1, "x", 1)], [(0, "a", 1), (None, "m", 1)])):
        table.add(spark.createDataFrame(new, KIND), "w", i)
    want = sorted([(0, "b", "own"), (1, "x", None), (None, "n", "own"), (None, "m", None)], key=repr)
    assert rows(table.read()) == want
    table.compact()
    assert rows(table.read()) == want
    table.add(spark.createDataFrame([(0, "a2", 1), (1, "y", 5)], KIND), "w", 2)
    assert rows(table.read()) == sorted([(0, "b", "own"), (1, "y", None), *want[2:]], key=repr)


# File-level merges


@pytest.fixture
def files(spark, tmp_path):
    target = spark.range(40_000).select("id", F.concat(F.lit("old"), F.col("id").cast("string")).alias("v"), F.lit("own").alias("own"))
    path = f"file://{tmp_path}/table"
    filemerge.write_files(target, path, ["id"], 20)
    return path, target, lambda: {n: os.stat(tmp_path / "table" / n).st_mtime_ns for n in os.listdir(tmp_path / "table") if n.endswith(".parquet")}


def test_only_files_of_the_keys_are_rewritten(spark, files):
    path, target, there = files
    before = there()
    delta = spark.range(10_000, 10_040).select("id", F.lit("new").alias("v"))
    told = filemerge.merge_files(spark, path, delta, ["id"])
    after = there()
    assert told["files"] == 20 and 1 <= told["rewritten"] <= 2 and told["written"] == 1
    assert len(before.items() & after.items()) == 20 - told["rewritten"]
    assert rows(spark.read.parquet(path)) == rows(merge.upsert(target, delta, ["id"]))
    assert filemerge.merge_files(spark, path, delta.limit(0), ["id"]) == {"files": len(after), "rewritten": 0, "written": 0}


def test_new_keys_rewrite_nothing(spark, files):
    path, target, there = files
    before = there()
    new = spark.createDataFrame([(50_000, "a", "x"), (50_000, "b", "x"), (None, "n", "x")], "id long, v string, own string")
    assert filemerge.merge_files(spark, path, new, ["id"], "v") == {"files": 20, "rewritten": 0, "written": 1}
    assert before.items() <= there().items()
    assert rows(spark.read.parquet(path).where("id >= 50000 OR id IS NULL")) == [(50_000, "b", "x"), (None, "n", "x")]


def test_merges_of_all_files_equal_an_upsert(spark, files, monkeypatch):
    path, target, _ = files
    monkeypatch.setattr(filemerge, "BROADCAST_KEYS", 10)
    delta = spark.range(0, 44_000, 7).select("id", F.lit(None).cast("string").alias("v"), F.lit("theirs").alias("own"))
    told = filemerge.merge_files(spark, path, delta, ["id"], keep_first=("own",), file_bytes=20_000)
    assert told["rewritten"] == 20 and told["written"] > 5
    assert rows(spark.read.parquet(path)) == rows(merge.upsert(target, delta, ["id"], keep_first=("own",)))


@pytest.mark.parametrize("moved", [0, 1])
def test_a_merge_that_is_cut_off_is_finished(spark, files, monkeypatch, moved):
    path, target, _ = files
    delta = spark.range(9_000, 15_000).select("id", F.lit("new").alias("v"))
    move, left = shared.move, [moved]

    def cut(*a):
        if not left[0]:
            raise OSError("gone")
        left[0] -= 1
        move(*a)

    monkeypatch.setattr(filemerge, "move", cut)
    with pytest.raises(OSError):
        filemerge.merge_files(spark, path, delta, ["id"], file_bytes=20_000)
    monkeypatch.setattr(filemerge, "move", move)
    filemerge.recover(spark, path)
    assert rows(spark.read.parquet(path)) == rows(merge.upsert(target, delta, ["id"]))


def test_a_merge_that_is_cut_off_before_its_journal_is_undone(spark, files, monkeypatch):
    path, target, there = files
    monkeypatch.setattr(filemerge, "write_state", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        filemerge.merge_files(spark, path, target.limit(5), ["id"])
    filemerge.recover(spark, path)
    assert len(there()) == 20 and rows(spark.read.parquet(path)) == rows(target)


def test_a_reload_replaces_files_only_when_it_is_written(spark, files):
    path, target, there = files
    with pytest.raises(Exception, match="bad row"):
        filemerge.replace_files(spark, path, target.withColumn("v", F.when(F.col("id") == 7, F.raise_error(F.lit("bad row"))).otherwise(F.col("v"))))
    assert rows(spark.read.parquet(path)) == rows(target)
    own = spark.read.parquet(path).where("id < 5").select("id", F.lit(1).alias("other"))
    told = filemerge.replace_files(spark, path, own)
    assert told["files"] == 20 and told["written"] == len(there())
    assert rows(spark.read.parquet(path)) == [(i, 1) for i in range(5)]
