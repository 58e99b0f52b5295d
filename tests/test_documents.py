"""Fields counted in a trie, texts that are no documents, the catch-all column, and samples by hash."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tablebridge.operators import documents
from tablebridge.plans import infer
from tablebridge.queries import QUERIES
from tablebridge.sources import scan


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def value(rng, depth):
    kinds = [None, True, 7, -3.5, 2**70, "text", [], [1, {"x": 1}], {}, {"$oid": "0a"}, {"$numberLong": "5"}, {"$date": {"$numberLong": "0"}}, {"$code": "f"}, {"$code": "f", "$scope": {}}, {"$minKey": 1}, {"$other": 1}, {"b": 1, "$oid": "x"}]
    if depth and rng.random() < 0.4:
        return {rng.choice(["a", "b", "c d", "é", "$x"]): value(rng, depth - 1) for _ in range(rng.randrange(4))}
    return rng.choice(kinds)


NOT_DOCUMENTS = ["[1,2]", '"s"', "7", "null", "broken", '{"a":1,"a":2}', '{"a":NaN}', "", None]


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(4)
    texts = [json.dumps({k: value(rng, 3) for k in rng.sample(["_id", "a", "b.c", "n", "", "deep"], 4)}) for _ in range(300)] + NOT_DOCUMENTS
    return spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)


@pytest.mark.parametrize("held", [3, 100_000])
def test_counted_fields_are_those_of_the_walk(spark, lines, monkeypatch, held):
    monkeypatch.setattr(documents, "HELD_FIELDS", held)
    parsed = documents.parse_documents(lines, "t")
    walked = documents.walk_documents(parsed)
    counts = documents.count_fields(lines, "t")
    want = walked.groupBy("field_name", "type_name").agg(F.count("*").alias("n"))
    assert rows(counts.where("field_name IS NOT NULL")) == rows(want) and want.count() > 60
    assert rows(counts.where("field_name IS NULL")) == [(None, "document", 300), (None, "rejected", len(NOT_DOCUMENTS))]
    assert rows(documents.text_frequency(lines, "t")) == rows(documents.field_frequency(walked, 300))


def test_fields_are_counted_in_one_scan_and_one_shuffle(lines):
    counts = documents.count_fields(lines, "t")
    counts.collect()
    plan = counts._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_deep_documents_are_counted(spark):
    text = "1"
    for i in range(300):
        text = '{"k%d":%s}' % (i, text)
    got = documents.count_fields(spark.createDataFrame([(text,), ("{}",)], "t string"), "t").where("field_name IS NOT NULL").collect()
    assert len(got) == 300 and max(r["field_name"].count(".") for r in got) == 299


def test_what_is_no_document_is_bad(spark):
    df = documents.parse_documents(spark.createDataFrame([(t,) for t in [*NOT_DOCUMENTS, '{"k":1}', "{}"]], "t string"), "t", "k")
    plan = [{"field_name": "k", "pg_column": "k", "pg_type": "bigint", "strategy": "direct"}]
    assert documents.walk_documents(df).count() == 1
    assert rows(documents.apply_plan(df, plan, on_error="skip")) == [(1, None), (None, None)]
    assert documents.rejected_documents(df, plan).count() == len(NOT_DOCUMENTS)
    with pytest.raises(Exception, match="does not convert"):
        documents.apply_plan(df.where("doc IS NOT NULL"), plan).collect()


def test_what_nobody_asks_for_is_not_made_but_the_check_is(spark):
    df = documents.parse_documents(spark.createDataFrame([(t,) for t in ['{"k":"x","more":1}', '{"k":2,"j":{"$oid":"0a"}}', "[1]"]], "t string"), "t", "k")
    plan = [{"field_name": f, "pg_column": f, "pg_type": t, "strategy": s} for f, t, s in (("k", "bigint", "direct"), ("j", "jsonb", "as_jsonb"))]
    out = documents.apply_plan(df, plan, on_error="skip")
    assert rows(out) == [(2, '"0a"', None)] and rows(out.select("j")) == [('"0a"',)] and out.count() == 1
    text = out.select("k")._jdf.queryExecution().optimizedPlan().toString()
    assert "StructsToJson" not in text and "map<string,variant>" not in text and text.count("parseJson") == 1
    whole = out._jdf.queryExecution().optimizedPlan().toString()
    assert whole.count("StructsToJson") == 2 and whole.count("parseJson") == 1
    with pytest.raises(Exception, match="does not convert"):
        documents.apply_plan(df, plan).select("j").collect()
    refused = documents.rejected_documents(df, plan)
    assert rows(refused.select("doc_id")) == [("x",), (None,)] and refused.columns == df.columns


def test_the_check_and_the_rest_are_made_without_work_on_planned_texts(spark):
    far = '{"$date":{"$numberLong":"9223372036854775807"}}'
    lines = ['{"k":{"$oid":"a1"},"d":{"x":%s},"n":{"$numberDecimal":"2.50"},"q`.r":null,"more":[1]}' % far, '{"k":{"$oid":null},"d":"t"}', '{"k":{"$regularExpression":{"options":"i"}}}', '{"n":"1.5e1","d":"[%s]"}' % "x"]
    df = documents.parse_documents(spark.createDataFrame([(t,) for t in lines], "t string"), "t", "k")
    plan = [{"field_name": f, "pg_column": f, "pg_type": t, "strategy": "direct"} for f, t in (("k", "text"), ("d", "text"), ("n", "numeric"))]
    out = documents.apply_plan(df, plan, on_error="skip")
    # a text is not made to know that it can be: this date is out of range, and nobody asks for it
    assert [(k, None if n is None else float(n), e) for k, n, e in rows(out.select("k", "n", "_extra"))] == [("a1", 2.5, '{"more":[1],"q`.r":null}'), (None, 15.0, None)]
    assert documents.rejected_documents(df, plan).count() == 2
    assert "map_filter" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_small_rows_of_heavy_work_are_dealt_by_their_number(spark):
    cores = spark.sparkContext.defaultParallelism
    assert scan.spread(spark.range(100), "id", 100).rdd.getNumPartitions() == cores
    assert scan.spread(spark.range(100), "id", 100, each=4).rdd.getNumPartitions() == 25


def test_the_catch_all_keeps_clear_of_fields_of_its_name(spark, tmp_path):
    df = documents.parse_documents(spark.createDataFrame([('{"_extra":1,"_extra_2":2,"k":3,"more":true}',)], "t string"), "t", "k")
    names = [r["pg_column"] for r in infer.column_names(spark.createDataFrame([("_extra",), ("_extra_2",), ("k",)], "field_name string")).orderBy("field_name").collect()]
    plan = [{"field_name": f, "pg_column": c, "pg_type": "bigint", "strategy": "direct"} for f, c in zip(["_extra", "_extra_2", "k"], names, strict=True)]
    out = documents.apply_plan(df, plan)
    assert out.first().asDict() == {"_extra": 1, "_extra_2": 2, "k": 3, "_extra_3": '{"more":true}'}
    out.write.parquet(f"{tmp_path}/out")
    table = spark.createDataFrame([(p["pg_column"], p["pg_type"], "direct", False, True) for p in plan], "pg_column string, pg_type string, strategy string, is_pk boolean, nullable boolean")
    assert {r["column_name"] for r in infer.plan_columns(table).collect()} == set(out.columns)


@pytest.mark.parametrize("n", [0, 1, 37, 999, 1000, 5000])
def test_samples_are_the_rows_of_lowest_hash(spark, n):
    df = spark.range(1000).withColumn("pad", F.repeat(F.lit("x"), 50))
    want = df.orderBy(F.xxhash64(F.lit(42), "id"), "id").limit(n)
    got = scan.sample_documents(df, "id", n, spare=3)
    assert rows(got) == rows(want) and got.columns == df.columns


def test_samples_of_repeated_keys_and_of_nothing(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(300)] + [(None, -1)], "k int, v int")
    assert scan.sample_documents(df, "k", 120, spare=5).count() == 120
    assert scan.sample_documents(df.limit(0), "k", 5).count() == 0


def test_names_that_no_table_matches(spark):
    tables = spark.createDataFrame([("Orders",), ("a.b",)], "table_name string")
    asked = spark.createDataFrame([(" orders ",), ("dbo.ORDERS",), ("a.b",), ("b",), ("x.a.b",), ("nope",), (None,)], "name string")
    got = scan.missing_tables(tables, asked)
    assert rows(got) == [("b",), ("nope",), ("x.a.b",), (None,)]
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_counts_come_from_footers(spark, tmp_path):
    spark.range(1000).write.parquet(f"{tmp_path}/a")
    spark.range(0).write.parquet(f"{tmp_path}/b")
    paths = {n: f"{tmp_path}/{n}" for n in "ab"}
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    assert rows(scan.estimated_counts(spark, paths)) == rows(scan.estimated_counts(spark, paths, exact=True)) == [("a", 1000), ("b", 0)]
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    total = scan.database_inventory(scan.table_inventory(spark, paths), "db").first()
    assert total["database"] == "db" and total["tables"] == 2 and total["size_bytes"] > 0 and total["size_human"].endswith("B")


def test_a_stream_of_one_file_is_parsed_by_all_cores(spark):
    out = QUERIES["stream_apply_plan"](spark, "/root/testdata/sf0.001")
    assert len(out.inputFiles()) == spark.sparkContext.defaultParallelism and out.count() == 1500
