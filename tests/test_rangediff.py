"""Differences by range digests against the plain row join."""

import datetime

import pytest
from pyspark.sql import functions as F

from tablebridge.operators import integrity, rangediff


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def source(spark):
    return spark.range(0, 60_000, 3).select("id", F.date_add(F.lit(datetime.date(2000, 1, 1)), (F.col("id") / 3).cast("int")).alias("day"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("name"), (F.col("id") * 7 % 100).alias("v"), F.when(F.col("id") % 5 > 0, "w").alias("w")).cache()


KEYS = [["id"], ["day"], ["name"], ["id", "name"]]


@pytest.mark.parametrize("keys", KEYS)
def test_equal_to_the_row_join(spark, source, keys):
    target = source.where("id NOT IN (30, 600)").withColumn("v", F.when(F.col("id").between(900, 906), -1).otherwise(F.col("v"))).withColumn("w", F.when(F.col("id") == 1200, "x").otherwise(F.col("w")))
    extra = spark.createDataFrame([(70_000, datetime.date(2100, 1, 1), "new", 1, None)], source.schema)
    columns = ["v", "w"]
    want = rows(integrity.diff_rows(source, target.union(extra), keys, columns))
    assert len(want) == 2 + 3 + 1 + 1
    for options in ({}, {"fan": 4, "leaf_rows": 50}, {"fan": 16, "leaf_rows": 0, "most": 3}):
        assert rows(rangediff.diff_ranges(source, target.union(extra), keys, columns, **options)) == want


@pytest.mark.parametrize("keys", KEYS)
def test_equal_tables_are_not_joined(spark, source, keys):
    again = source.repartition(3).orderBy(F.desc("name"))
    assert rangediff.differing(source, again, keys, ["v", "w"]).parts == []
    got = rangediff.diff_ranges(source, again, keys, ["v", "w"])
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString() and got.count() == 0


def test_few_ranges_of_a_small_change(source):
    target = source.withColumn("v", F.when(F.col("id") == 30_000, -1).otherwise(F.col("v")))
    found = rangediff.differing(source, target, ["id"], ["v"], fan=32, leaf_rows=100)
    assert len(found.parts) == 1 and found.rows <= 100
    filters = found.rows_of(source, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "id" in filters and ">=" in filters


def test_null_and_repeated_keys_and_moved_nulls(spark):
    kind = "k long, a string, b string"
    s = spark.createDataFrame([(None, "x", "y"), (1, None, "n"), (2, "a", "b"), (2, "a", "b"), (-(2**63), "low", None), (2**63 - 1, "high", None)], kind)
    assert rangediff.diff_ranges(s, s.orderBy("a"), ["k"], ["a", "b"]).count() == 0
    t = spark.createDataFrame([(None, "x", "z"), (1, "n", None), (2, "a", "b"), (-(2**63), "low", None), (2**63 - 1, "high", None)], kind)
    got = rows(rangediff.diff_ranges(s, t, ["k"], ["a", "b"], leaf_rows=0))
    assert got == rows(integrity.diff_rows(s, t, ["k"], ["a", "b"])) == sorted([(None, "changed", "b"), (1, "changed", "a,b")], key=repr)


def test_empty_sides(spark, source):
    none = source.limit(0)
    assert rangediff.diff_ranges(none, none, ["id"], ["v"]).count() == 0
    assert rangediff.diff_ranges(source, none, ["id"], ["v"]).where("status = 'missing'").count() == 20_000
