"""Single operators on small rows: reference vectors, edge cases and properties."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablebridge.operators import documents, integrity, merge, runs, sync
from tablebridge.plans import compare, infer, store
from tablebridge.sources import scan


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upsert_is_idempotent_and_last_wins(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, v string, extra int")
    s = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, None, 1)], "id int, v string, at int")
    once = merge.upsert(t, s, ["id"], order_by="at")
    assert rows(once) == [(1, "a", 1), (2, "y", 2), (3, None, None)]
    assert rows(merge.upsert(once, s, ["id"], order_by="at")) == rows(once)
    assert rows(merge.replace_rows(t, s.drop("at").limit(1), ["id"])) == [(1, "a", 1), (2, "x", None)]


def test_unkeyed_rows_meet_a_unique_index(spark):
    t = spark.createDataFrame([("a", 1, "x"), (None, 2, "y")], "code string, at int, own string")
    s = spark.createDataFrame([("a", 3), ("b", 5), ("b", 4), (None, 6), (None, 6)], "code string, at int")
    free = [(None, 6, None), (None, 6, None)]
    assert rows(merge.append_unkeyed(t, s)) == sorted(rows(t) + [(*r, None) for r in rows(s)], key=repr)
    assert rows(merge.append_unkeyed(t, s, ["code"], order_by="at")) == sorted([("a", 1, "x"), (None, 2, "y"), ("b", 4, None), *free], key=repr)
    assert rows(merge.append_unkeyed(t, s, ["code"], "update", "at")) == sorted([("a", 3, "x"), (None, 2, "y"), ("b", 5, None), *free], key=repr)
    with pytest.raises(ValueError):
        merge.append_unkeyed(t, s, ["code"], "drop")


def test_bulk_append_needs_an_empty_target(spark):
    t = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(ValueError):
        merge.bulk_append(t, t)


def test_bulk_text(spark):
    df = spark.createDataFrame([("tab\there\nnewline\\backslash", None, True), ("", "454.30", False)], "a string, b string, c boolean")
    assert [r[0] for r in merge.bulk_text_line(df).collect()] == ["tab\\\there\\\nnewline\\\\backslash\t\\N\t1", "\t454.30\t0"]


@pytest.mark.parametrize("n", [1, 3, 7, 50])
def test_segments_are_disjoint_and_cover(spark, n):
    df = spark.createDataFrame([(i * 3,) for i in range(20)], "id long")
    seg = scan.pk_segments(df, "id", n).orderBy("seg_id").collect()
    assert sum(r["rows"] for r in seg) == 20 and all(a["seg_to"] + 1 == b["seg_from"] for a, b in zip(seg, seg[1:], strict=False))
    assert seg[0]["seg_from"] == 0 and seg[-1]["seg_to"] == 57
    pos = [r["position"] for r in scan.offset_segments(df, ["id"], n).orderBy("id").collect()]
    assert pos == list(range(20))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long")
    assert scan.pk_segments(none, "id", 4).count() == 0
    assert scan.batch_manifest(none, "id").count() == 0
    assert scan.pk_bounds(none, "id").first() == (None, None, 0)


def test_batches(spark):
    got = scan.batch_manifest(spark.createDataFrame([(i,) for i in range(5)], "id long"), "id", 2).orderBy("batch_id").collect()
    assert [tuple(r) for r in got] == [(1, 2, 0, 1, 2), (2, 2, 2, 3, 4), (3, 1, 4, 4, 5)]


def test_walk_and_frequency(spark):
    docs = spark.createDataFrame(
        [('{"_id":{"$oid":"0a"},"address":{"city":"x","zip":null},"tags":["a"],"notes":null}',), ('{"_id":{"$oid":"0b"},"address":{"city":{"$numberInt":"1"}}}',), ("broken",)], "t string"
    )
    parsed = documents.parse_documents(docs, "t")
    walked = documents.walk_documents(parsed.where("doc IS NOT NULL"))
    freq = {r["field_name"]: r for r in documents.field_frequency(walked, 2).collect()}
    assert set(freq) == {"_id", "address", "address.city", "address.zip", "tags", "notes"}
    assert freq["notes"]["occurrences"] == 0 and freq["notes"]["null_count"] == 1 and freq["notes"]["absent_count"] == 1
    assert freq["address.city"]["polymorphic"] and freq["tags"]["coverage"] == 50.0


def test_walk_enters_every_level(spark):
    deep = "1"
    for i in range(25):
        deep = '{"k%d":%s}' % (i, deep)
    df = documents.parse_documents(spark.createDataFrame([(deep,)], "t string"), "t")
    got = [r["field_name"] for r in documents.walk_documents(df).collect()]
    assert len(got) == 25 and max(x.count(".") for x in got) == 24


def test_rare_types(spark):
    text = '{"a":{"$code":"f"},"b":{"$code":"f","$scope":{}},"c":{"$symbol":"s"},"d":{"$undefined":true},"e":{"$dbPointer":{"$ref":"r","$id":{"$oid":"0a"}}},"f":{"$minKey":1},"g":{"x":1}}'
    df = documents.parse_documents(spark.createDataFrame([(text,)], "t string"), "t")
    got = {r["field_name"]: r["type_name"] for r in documents.walk_documents(df).collect()}
    assert got == {"a": "JavaScript", "b": "CodeWithScope", "c": "Symbol", "d": "Undefined", "e": "DBPointer", "f": "MinKey", "g": "Document", "g.x": "Int64"}


def test_dates_inside_json(spark):
    text = '{"v":{"at":{"$date":{"$numberLong":"1700000000120"}},"old":{"$date":{"$numberLong":"-1000"}},"iso":{"$date":"2024-01-02T03:04:05Z"},"n":[{"$date":{"$numberLong":"0"}}],"s":"{\\"$date\\":{}}"}}'
    df = documents.parse_documents(spark.createDataFrame([(text,)], "t string"), "t")
    plan = [{"field_name": "v", "pg_column": "v", "pg_type": "jsonb", "strategy": "as_jsonb"}]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = json.loads(documents.apply_plan(df, plan).first()["v"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == {"at": "2023-11-14T22:13:20.12Z", "old": "1969-12-31T23:59:59Z", "iso": "2024-01-02T03:04:05Z", "n": ["1970-01-01T00:00:00Z"], "s": '{"$date":{}}'}


def test_values_convert_exactly_or_not(spark):
    texts = ['{"n":{"$numberDecimal":"2.123456789"},"i":7}', '{"n":1,"i":{"$numberLong":"9000000000"}}', '{"n":{"$numberDecimal":"1E-30"},"i":1}', '{"n":{"$numberDecimal":"12.50"},"i":null}', '{"n":"x"}', "broken", '{"n":{"$numberDecimal":"1E+3"}}']
    df = documents.parse_documents(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "n")
    plan = [{"field_name": f, "pg_column": f, "pg_type": k, "strategy": "direct"} for f, k in (("n", "numeric"), ("i", "integer"))]
    got = documents.apply_plan(df, plan, on_error="skip").collect()
    assert sorted((float(r["n"]), r["i"]) for r in got if r["i"]) == [(2.123456789, 7)] and str(got[0]["n"]).startswith("2.123456789")
    assert len(got) == 3 and documents.rejected_documents(df, plan).count() == 4
    assert documents.apply_plan(df, plan, on_error="null").count() == 7


def test_flattened_children_are_checked_alike(spark):
    texts = ['{"p":{"x":"no"}}', '{"p":{"x":1,"y":{"z":2}}}', '{"p":3}', "broken", '{"p":{"x":null}}']
    df = documents.parse_documents(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "p")
    plan = [
        {"field_name": "p", "pg_column": "p", "pg_type": "", "strategy": "flatten"}, {"field_name": "p.x", "pg_column": "p_x", "pg_type": "integer", "strategy": "direct"},
        {"field_name": "p.y.z", "pg_column": "p_y_z", "pg_type": "integer", "strategy": "direct"},
    ]
    kept, gone = documents.apply_plan(df, plan, on_error="skip").collect(), documents.rejected_documents(df, plan)
    assert len(kept) == 3 and gone.count() == 2 and gone.columns == df.columns
    assert {(r["p_x"], r["p_y_z"], r["_extra"]) for r in kept} == {(1, None, '{"p.y":{"z":2}}'), (None, None, '{"p":3}'), (None, None, None)}


def test_plan_compiles_in_one_scan(spark):
    from tablebridge.queries.documents import _rows, order_documents

    out = documents.apply_plan(order_documents(spark, "/root/testdata/sf0.001"), _rows())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("orders.parquet") == 1


def test_plan_conserves_fields(spark):
    doc = {"a": {"$numberLong": "5"}, "b": {"x": 1, "y": "z"}, "c": [1, {"$oid": "ff"}], "d": "left"}
    df = documents.parse_documents(spark.createDataFrame([(json.dumps(doc),)], "t string"), "t", "a")
    plan = [
        {"field_name": "a", "pg_column": "a", "pg_type": "bigint", "strategy": "direct"},
        {"field_name": "b", "pg_column": "b", "pg_type": "jsonb", "strategy": "flatten"},
        {"field_name": "b.x", "pg_column": "b_x", "pg_type": "integer", "strategy": "direct"},
        {"field_name": "c", "pg_column": "c", "pg_type": "jsonb", "strategy": "as_jsonb"},
    ]
    assert documents.apply_plan(df, plan).first().asDict() == {"a": 5, "b_x": 1, "c": '[1,"ff"]', "_extra": '{"b.y":"z","d":"left"}'}


def test_bad_values(spark):
    df = documents.parse_documents(spark.createDataFrame([('{"a":"x"}',), ('{"a":1}',)], "t string"), "t", "a")
    plan = [{"field_name": "a", "pg_column": "a", "pg_type": "bigint", "strategy": "direct"}]
    assert [r["a"] for r in documents.apply_plan(df, plan, on_error="skip").collect()] == [1]
    assert documents.rejected_documents(df, plan).count() == 1
    with pytest.raises(Exception, match="does not convert"):
        documents.apply_plan(df, plan).collect()


@pytest.mark.parametrize(
    ("types", "want"),
    [(["Int32", "Int64"], "bigint"), (["Double", "Decimal128"], "numeric"), (["Int32", "Double"], "double precision"), (["Int32", "String"], "text"), (["String", "Document"], "jsonb"), ([], "text"), (["Timestamp"], "jsonb"), (["Date"], "timestamptz")],
)
def test_widening(spark, types, want):
    df = spark.createDataFrame([("f", [(t, 1) for t in types], 0, 0)], "field_name string, types array<struct<type_name:string,count:int>>, null_count int, absent_count int")
    got = infer.infer_types(df).first()
    assert got["pg_type"] == want and got["strategy"] == ("as_jsonb" if want == "jsonb" else "direct")


def test_names(spark):
    df = spark.createDataFrame([("customer_id",), ("1field",), ("my-field.name",), ("a" * 100,), ("address_city",), ("address.city",), ("",), ("x",), ("x_2",), ("x.2",)], "field_name string")
    got = {r["field_name"]: r["pg_column"] for r in infer.column_names(df).collect()}
    assert got["1field"] == "_1field" and got["my-field.name"] == "my_field_name" and len(got["a" * 100]) == 63 and got[""] == "_field"
    assert got["address.city"] == "address_city" and got["address_city"] == "address_city_2"
    assert len(set(got.values())) == len(got)


def test_names_fit_and_never_clash(spark):
    fields = [("é" * 40 + x,) for x in (".", "-", " ")] + [(f"{'x' * 70}{i}",) for i in range(130)] + [("a.b",), ("a_b",), ("a_b_2",), ("a-b",), ("a b",), ("a_b_2_2",), ("a.b.2",)]
    got = [r["pg_column"] for r in infer.column_names(spark.createDataFrame(fields, "field_name string")).collect()]
    assert len(set(got)) == len(fields) and max(len(x.encode()) for x in got) <= 63


def test_override_survives_and_is_partial(spark):
    kind = "project_id string, collection string, field_name string, pg_column string, pg_type string, strategy string, is_pk boolean, nullable boolean"
    inferred = spark.createDataFrame([("p", "c", "f", "f", "double precision", "direct", False, True)], kind)
    empty = spark.createDataFrame([], kind + ", overridden boolean")
    plan = store.merge_plan(empty, inferred)
    changed = store.override_plan(plan, spark.createDataFrame([("p", "c", "f", None, "numeric", None, None, None), ("p", "", "f", None, "x", "direct", None, None)], kind))
    assert rows(store.merge_plan(changed, inferred)) == [("p", "c", "f", "f", "numeric", "direct", False, True, True)]
    assert rows(store.frozen_plan(store.freeze_plan(changed))) == rows(changed)


def test_types():
    assert compare.to_spark_type("tinyint(1)") == T.BooleanType() and compare.to_spark_type("decimal(10,2)") == T.DecimalType(10, 2)
    assert compare.to_spark_type("double precision") == T.DoubleType() and compare.to_spark_type("jsonb") == T.StringType()


def test_jdbc_round_trip(spark):
    url = "jdbc:derby:memory:bridge;create=true"
    props = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(100).withColumn("v", F.col("id").cast("string")).write.jdbc(url, "t", mode="overwrite", properties=props)
    got = scan.read_jdbc(spark, url, "t", "id", 4, props)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 100


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_positions_hold_under_uneven_payload(spark, tmp_path, adaptive):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100000")
    try:
        wide = spark.range(60_000).withColumn("pad", F.when(F.col("id") < 6_000, F.repeat(F.sha2(F.col("id").cast("string"), 256), 12)).otherwise(""))
        scan.offset_segments(wide, ["id"], 7).write.parquet(f"{tmp_path}/out")
        told = spark.read.parquet(f"{tmp_path}/out")
        assert told.count() == 60_000 and told.where("position IS NULL OR position <> id OR seg_id <> floor(id / 8572)").count() == 0
        assert scan.batch_manifest(wide, "id", 1000).where("rows_in_batch <> 1000 OR first_key <> (batch_id - 1) * 1000").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_states_of_a_stream_go_on_after_a_restart(spark, tmp_path):
    from tablebridge.streaming import sync as streaming

    def counts(new):
        if new:
            spark.createDataFrame(new, "id long, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streaming.read_stream(spark, f"{tmp_path}/in", "*.parquet", T.StructType.fromDDL("id long, v string"))
        return rows(streaming.stream_state(stream.groupBy("v").count(), f"{tmp_path}/state", f"{tmp_path}/cp"))

    assert counts([(1, "a"), (7, "a")]) == counts([]) == [("a", 2)]
    assert counts([(1, "b"), (9, "c")]) == counts([]) == [("a", 2), ("b", 1), ("c", 1)]


def test_upsert_of_some_columns_keeps_the_others(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "n", "z")], "id int, v string, own string")
    s = spark.createDataFrame([(2, "c"), (3, "d"), (None, "m")], "id int, v string")
    assert rows(merge.upsert(t, s, ["id"])) == sorted([(1, "a", "x"), (2, "c", "y"), (3, "d", None), (None, "n", "z"), (None, "m", None)], key=repr)
    plan = merge.upsert(t, t, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and "LeftAnti" in plan


def test_done_constraints_are_not_computed(spark):
    df = spark.createDataFrame([(1,)], "id int")
    checks = [{"table": "t", "name": "a", "kind": "check", "sql": "no_such_column > 0"}, {"table": "t", "name": "b", "kind": "not_null", "columns": ["id"]}]
    done = spark.createDataFrame([("t", "a"), ("u", "b")], "table_name string, name string")
    assert rows(integrity.check_constraints({"t": df}, checks, done)) == [("t", "b", "not_null", 0)]
    assert integrity.check_constraints({"t": df}, checks[:1], done).count() == 0


def test_choices(spark):
    def options(*types):
        df = spark.createDataFrame([("f", [(t, 1) for t in types], 0, 0)], "field_name string, types array<struct<type_name:string,count:int>>, null_count int, absent_count int")
        return infer.infer_types(df).first()["options"]

    assert options("Document") == ["jsonb", "flatten", "skip"] and options("Int32") == ["integer", "bigint", "text"] and options("MinKey") == ["jsonb", "skip"]
    assert options("Double", "Decimal128") == ["numeric", "double precision", "jsonb"] and options("Boolean", "Date") == ["jsonb", "text", "skip"] and options() == ["text"]


def test_sqlite_ddl_holds_its_constraints(spark):
    columns = spark.createDataFrame([("t", "a", "integer", False, True, 1, None), ("t", "b", "text", True, False, 2, "'x'")], "table_name string, column_name string, type string, nullable boolean, is_pk boolean, ordinal int, default string")
    more = spark.createDataFrame([("t", "c1", "check", None, None, None, "b <> ''"), ("t", "f1", "foreign_key", "a,b", "u", "x,y", None)], "table_name string, name string, kind string, columns string, ref_table string, ref_columns string, clause string")
    want = """CREATE TABLE IF NOT EXISTS "t" ("a" integer NOT NULL, "b" text DEFAULT 'x', PRIMARY KEY ("a"), FOREIGN KEY ("a", "b") REFERENCES "u" ("x", "y"), CHECK (b <> ''))"""
    assert compare.render_ddl(columns, "sqlite", more).first()["ddl"] == want
    with pytest.raises(ValueError):
        merge.alter_columns(columns, [{"kind": "add", "name": "z", "type": "int", "nullable": False}])


def test_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3), (1, 4)], "k int, v int")
    assert integrity.check_unique(df, ["k"]).count() == 1 and integrity.check_primary_key(df, ["k"]).count() == 2


def test_redaction(spark):
    df = spark.createDataFrame([("mongodb://u:p@h/db", "s"), ("u:p@q@tcp(h)/d", "")], "dsn string, password string")
    assert rows(runs.redact_credentials(df, ["dsn"], ["password"])) == [("***:***@tcp(h)/d", ""), ("mongodb://***:***@h/db", "***")]
    hidden = {"postgres://u:pa/ss@h/db": "postgres://***:***@h/db", "mysql://u:p@ss@h/db": "***:***@h/db", "u:p\nq@h": "***:***@h", "postgres://h/db": "postgres://h/db", "": ""}
    got = spark.createDataFrame([(k,) for k in hidden], "t string").select("t", runs.redacted(F.col("t")))
    assert dict(map(tuple, got.collect())) == hidden


def test_rates_hold_no_log_in_a_row(spark):
    rng = random.Random(6)
    log = [(run, seq, rng.choice([5, 9, None]), rng.choice([0.0, 0.25, 1.5, None]), 0.5 + seq % 3, seq * 0.4, None if run == 5 and seq == 30 else float(seq * rng.randrange(1, 4))) for run, n in ((1, 900), (2, 3), (5, 50), (None, 40)) for seq in range(n)]
    log.append((4, 0, 5, 0.0, 0.0, 0.0, 1.0))
    rng.shuffle(log)
    df = spark.createDataFrame(log, "run_id long, seq long, batch_rows long, read_seconds double, write_seconds double, t double, rows_done double").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))

    def smooth(xs):
        a = None
        for x in xs:
            a = x if a is None else 0.3 * x + 0.7 * a
        return a

    got = {r["run_id"]: (r["read_rate"], r["write_rate"]) for r in runs.smoothed_rates(df, blocks=7).collect()}
    assert set(got) == {1, 2, 4, 5, None} and got[4] == (None, None)
    for run, told in got.items():
        own = sorted(r[1:5] for r in log if r[0] == run and r[2] is not None)
        for i, x in enumerate(told):
            want = smooth(r[1] / r[2 + i] for r in sorted(own, key=lambda r: r[0]) if r[2 + i])
            assert (x is None and want is None) or abs(x - want) < 1e-9 * want


def walked_rate(log, least=1.0):
    """log: (t, rows, kind) in order."""
    at, done, known, rate = None, 0.0, 0.0, 0.0
    for t, told, kind in log:
        if t is None or (told is None and kind != "resumed"):
            continue
        known = known if told is None else told
        if at is None or kind == "resumed" or t - at >= least * 1e6:
            if at is not None and kind != "resumed" and known > done:
                new = (known - done) * 1e6 / (t - at)
                rate = new if rate == 0 else 0.3 * new + 0.7 * rate
            at, done = t, known
    return rate


@pytest.mark.parametrize("clock", ["forward", "any"])
def test_throughput_is_folded_in_blocks(spark, clock):
    rng = random.Random(clock)
    logs = {}
    for run, n in ((1, 900), (2, 3), (None, 60), (5, 300), (6, 1), (7, 4)):
        t, done, log = 1_700_000_000_000_000, 0, []
        for i in range(n):
            t += rng.choice([0, 1, 300_000, 999_999, 1_000_000, 5_000_000]) if clock == "forward" else rng.randrange(-3_000_000, 4_000_000)
            done += rng.randrange(0, 9)
            log.append((t, None if run == 5 and rng.random() < 0.3 else float(done), "resumed" if rng.random() < 0.05 else "batch"))
        logs[run] = log
    logs[7] = [(None, 5.0, "batch"), (10, None, "batch"), (20, None, "resumed"), (5_000_020, 8.0, "batch")]
    rows_ = [(run, i, *e) for run, log in logs.items() for i, e in enumerate(log)]
    rng.shuffle(rows_)
    df = spark.createDataFrame(rows_, "run_id long, seq long, t long, rows_done double, kind string").withColumn("ts", F.timestamp_micros("t")).repartition(5)
    for block in (40, 10_000):
        got = {r["run_id"]: r["rate"] for r in runs.throughput(df, block_rows=block).collect()}
        assert got.keys() == logs.keys()
        assert all(got[k] == pytest.approx(walked_rate(log), rel=1e-9) for k, log in logs.items())
    dealt = runs.throughput(df, block_rows=40)._jdf.queryExecution().toString()
    assert "Cogroup" in dealt or "CoGroup" in dealt
    assert runs.throughput(df.limit(0)).count() == 0


def test_a_large_run_is_folded_by_many_blocks(spark, monkeypatch):
    seen = []
    keep = runs.stored
    monkeypatch.setattr(runs, "stored", lambda df, name: seen.append(keep(df, name)) or seen[-1])
    events = spark.range(4000).select(F.lit(1).alias("run_id"), F.col("id").alias("seq"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("rows_done"))
    assert runs.throughput(events, block_rows=500).first()["rate"] == pytest.approx(1.0)
    assert seen[0].select("block").distinct().count() == 8


def test_history_has_idle_intervals(spark):
    at = "2024-01-01 00:00:"
    log = [(1, f"{at}01", 5, "batch"), (1, f"{at}58", 6, "batch"), (1, f"{at}58.5", None, "complete"), (2, f"{at}07", 3, "batch"), (None, f"{at}00", 1, "batch"), (None, f"{at}30", 1, "batch")]
    df = spark.createDataFrame(log, "run_id int, ts string, batch_rows int, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    for block in (1, 5, 4096):
        got = runs.stats_history(df, every="5 seconds", block=block).collect()
        own = sorted((r["snapshot_at"].second or 60, r["rows_transferred"], r["rate"], r["final"]) for r in got if r["run_id"] == 1)
        assert own[:11] == [(5 * i, 5, 1.0 if i == 1 else 0.0, False) for i in range(1, 12)]
        assert own[11:] == [(58, 11, 0.0, True), (60, 11, 1.2, False)]
        assert sum(r["run_id"] is None for r in got) == 7 and sum(r["run_id"] == 2 for r in got) == 1
    assert runs.stats_history(df.limit(0)).count() == 0


def test_idle_intervals_are_made_last_and_summed_by_hash(spark):
    df = spark.createDataFrame([(1, 0, 5, "batch"), (1, 900, 6, "complete")], "run_id int, s long, batch_rows int, kind string").withColumn("ts", F.timestamp_seconds("s"))
    plan = runs.stats_history(df)._jdf.queryExecution().executedPlan().toString()
    made = plan[: plan.rindex("Generate")]
    assert not any(held in made.split("Window")[0] for held in ("Exchange", "Aggregate", "Sort"))
    assert "SortAggregate" not in runs.history_summary(runs.stats_history(df))._jdf.queryExecution().executedPlan().toString()
    assert runs.history_summary(runs.stats_history(df)).first()["snapshots"] == 182


def test_the_log_sorts_its_events_once(spark):
    from tablebridge.queries.runs import log

    got = log(spark, "/root/testdata/sf0.001")
    assert got._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    last = got.groupBy("run_id", "table_name").agg(F.max("seq").alias("seq")).withColumn("last", F.lit(True))
    ends = got.join(last, ["run_id", "table_name", "seq"], "left").select(F.col("last").isNotNull(), (F.col("kind") == "batch") & (F.col("run_id") % 5 != 0) | (F.col("run_id") % 5 == 0) & F.col("last").isNull()).distinct().collect()
    assert sorted(map(tuple, ends)) == [(False, True), (True, False)]


def test_history_with_totals_over_many_blocks(spark):
    rng = random.Random(11)
    log = [(run, rng.randrange(3000), rng.choice([None, 1, 7])) for run in (1, 2, 3) for _ in range(40)] + [(None, 10, 2), (None, 700, 3)]
    df = spark.createDataFrame(log, "run_id int, s long, batch_rows int").select("run_id", F.timestamp_seconds("s").alias("ts"), "batch_rows", F.when(F.col("run_id") == 2, "error").otherwise("batch").alias("kind"))
    totals = spark.createDataFrame([(1, 1000), (2, 0), (4, 5), (None, 9)], "run_id int, rows_total long")
    want = []
    for run in (1, 2, 3, None):
        own, total = [(s, n or 0) for r, s, n in log if r == run], {1: 1000, 2: 0}.get(run)
        percent = lambda n, total=total: n * 100 // total if total else 0
        for end in range(min(own)[0] // 10 * 10 + 10, max(own)[0] // 10 * 10 + 11, 10):
            done = sum(n for s, n in own if s < end)
            want.append((run, end, done, sum(n for s, n in own if end - 10 <= s < end) / 10, False, total, percent(done)))
        if run == 2:
            done = sum(n for _, n in own)
            want.append((run, max(own)[0], done, 0.0, True, total, percent(done)))
    for block in (1, 3, 32, 4096):
        got = runs.stats_history(df, totals, "10 seconds", block).withColumn("snapshot_at", F.unix_timestamp("snapshot_at"))
        assert got.columns == ["run_id", "snapshot_at", "rows_transferred", "rate", "final", "rows_total", "percent"]
        assert rows(got) == sorted(want, key=repr)
    plan = runs.stats_history(df, totals)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")


def test_names_of_numbered_keys(spark):
    rows_ = [("t", "0", "u", 2, "b", "y"), ("t", "0", "u", 1, "a", "x"), ("t", "own", "u", 1, "c", "z")]
    df = spark.createDataFrame(rows_, "table_name string, constraint_name string, ref_table string, position int, column_name string, ref_column string")
    assert rows(compare.assemble_foreign_keys(df)) == [("t", "fk_t_0", "a,b", "u", "x,y"), ("t", "own", "c", "u", "z")]


def test_status_is_sorted_by_table(spark):
    own = spark.createDataFrame([(1, "z", "done", 1, 1), (1, "b", "done", 1, 1)], "run_id int, table_name string, status string, rows_total long, rows_transferred long")
    registry = spark.createDataFrame([("a", "completed", 5, 5, 2), ("c", "completed", 5, 5, 1)], "table_name string, status string, rows_total long, rows_transferred long, last_migration_id int")
    assert [tuple(r) for r in runs.project_status(own, registry, 1).collect()] == [("a", "pending", 5, 0), ("b", "done", 1, 1), ("c", "completed", 5, 5), ("z", "done", 1, 1)]


def test_plans_are_frozen_by_collection(spark):
    kind = "project_id string, collection string, field_name string, pg_column string, pg_type string, strategy string, is_pk boolean, nullable boolean, overridden boolean"
    rows_ = [(p, c, f"f{i}", f"f{i}", "text", "direct", False, True, False) for p in "pq" for c in "abc" for i in range(3)]
    plan = spark.createDataFrame(rows_, kind)
    frozen = store.freeze_plan(plan)
    assert frozen.count() == 6 and set(map(tuple, store.frozen_plan(frozen).collect())) == set(rows_)
