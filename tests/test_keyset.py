"""The keyset source: restarts read only keys after the stored one, and only row groups that hold them."""

import datetime
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tablebridge.sources import keyset


def add(tmp_path, name, keys, kind=None, **options):
    os.makedirs(tmp_path / "in", exist_ok=True)
    pq.write_table(pa.table({"id": pa.array(keys, kind), "v": pa.array([f"v{k}" for k in keys], pa.string())}), tmp_path / "in" / f"{name}.parquet", **options)


def run(spark, tmp_path, checkpoint="cp", after=""):
    """The rows of each batch that a run of the stream reads."""
    batches = []
    stream = keyset.stream_keyset(spark, f"file://{tmp_path}/in", "id", after, 3)
    query = stream.writeStream.foreachBatch(lambda df, i: batches.append(sorted(r["id"] for r in df.collect()))).option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start()
    query.awaitTermination()
    return [b for b in batches if b]


def test_the_last_key_is_stored_and_a_restart_reads_on(spark, tmp_path):
    add(tmp_path, "a", ["key_001", "key_002", "key_003"])
    assert run(spark, tmp_path) == [["key_001", "key_002", "key_003"]]
    assert keyset.last_token(spark, f"{tmp_path}/cp") == "key_003"
    assert run(spark, tmp_path) == []
    add(tmp_path, "b", ["key_005", "key_004", None])
    assert run(spark, tmp_path) == [["key_004", "key_005"]]
    assert keyset.last_token(spark, f"{tmp_path}/cp") == "key_005"
    # a new checkpoint goes on behind a token that a run has stored
    assert run(spark, tmp_path, "cp2", after="key_001") == [["key_002", "key_003", "key_004", "key_005"]]
    assert keyset.last_token(spark, f"{tmp_path}/none") == ""


def test_batches_read_a_range(spark, tmp_path):
    for i in range(5):
        add(tmp_path, f"f{i}", list(range(i * 100, i * 100 + 100)), row_group_size=10)
    df = keyset.read_keyset(spark, f"file://{tmp_path}/in", "id", "249", 4)
    assert df.dtypes == [("id", "bigint"), ("v", "string")]
    assert sorted(r["id"] for r in df.collect()) == list(range(250, 500)) and 2 <= df.rdd.getNumPartitions() <= 4
    assert keyset.read_keyset(spark, f"file://{tmp_path}/in", "id", "499").count() == 0


@pytest.mark.parametrize("parts", [1, 3, 100])
def test_ranges_are_disjoint_and_cover(tmp_path, parts):
    add(tmp_path, "a", [5, 1, 9, 9, -3, 40], row_group_size=2)
    add(tmp_path, "b", [41, 60, 7], row_group_size=1)
    table = keyset.KeysetTable(str(tmp_path / "in"), "id")
    ranges = table.ranges("1", "60", parts)
    assert ranges[0].low == "1" and ranges[-1].high == "60" and len(ranges) <= parts
    assert all(a.high == b.low for a, b in zip(ranges, ranges[1:], strict=False))
    got = [k for r in ranges for b in table.read(r, pa.schema([("id", pa.int64())])) for k in b["id"].to_pylist()]
    assert sorted(got) == [5, 7, 9, 9, 40, 41, 60]
    assert table.ranges("60", "60", parts) == []


def test_only_row_groups_of_the_range_are_read(tmp_path, monkeypatch):
    for i in range(4):
        add(tmp_path, f"f{i}", list(range(i * 100, i * 100 + 100)), row_group_size=25)
    table = keyset.KeysetTable(str(tmp_path / "in"), "id")
    high = pa.compute.field("id") > 320
    groups = sum(len(f.subset(filter=high).row_groups) for f in table.data.get_fragments(filter=high))
    assert groups == 4 and table.tops(320) == [324, 349, 374, 399]


def test_keys_without_statistics_and_other_kinds(spark, tmp_path):
    days = [datetime.date(2024, 1, i) for i in (3, 1, 2)]
    add(tmp_path, "a", days, write_statistics=False)
    assert run(spark, tmp_path) == [sorted(days)]
    add(tmp_path, "b", [datetime.date(2024, 2, 1)])
    assert run(spark, tmp_path) == [[datetime.date(2024, 2, 1)]]
    for key in (7, "x", datetime.date(2024, 1, 2), datetime.datetime(2024, 1, 2, 3, 4, 5, 6)):
        kind = pa.scalar(key).type
        assert keyset.token_key(keyset.key_token(key), kind) == key


def test_an_empty_table(spark, tmp_path):
    add(tmp_path, "a", [], pa.int64())
    assert run(spark, tmp_path) == [] and keyset.read_keyset(spark, f"{tmp_path}/in", "id").count() == 0
    add(tmp_path, "b", [3, 1])
    assert run(spark, tmp_path) == [[1, 3]]
