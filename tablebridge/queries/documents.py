"""Documents built from orders, customers and nations; walked, counted and turned into columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablebridge.operators import documents as docs
from tablebridge.plans import infer
from tablebridge.queries import query
from tablebridge.sources.scan import scan_table as table
from tablebridge.sources.scan import spread
from tablebridge.sources.shared import shared_path
from tablebridge.streaming import sync as streaming


def _text(tag: str, value) -> F.Column:
    return F.concat(F.lit('{"' + tag + '":"'), value.cast("string"), F.lit('"}'))


def order_json(orders: DataFrame) -> DataFrame:
    """json: a document of each order (with n_name of its customer's nation)."""
    k = F.col("o_orderkey")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    fields = [
        ("_id", F.lit(True), _text("$oid", F.translate(F.lpad(F.hex(k), 24, "0"), "ABCDEF", "abcdef"))),
        ("customer_id", F.lit(True), _text("$numberLong", F.col("o_custkey"))),
        ("total", F.lit(True), F.when(k % 33 == 0, _text("$numberDecimal", F.lit("12.50"))).otherwise(_text("$numberDouble", k % 1000 + F.lit(0.5)))),
        ("qty", F.lit(True), F.when(k % 4 == 0, _text("$numberLong", k % 50)).otherwise(_text("$numberInt", k % 50))),
        ("code", F.lit(True), F.when(k % 9 == 0, quoted(F.concat(F.lit("c"), k.cast("string")))).otherwise(_text("$numberInt", k % 10))),
        ("ordered_at", F.lit(True), F.concat(F.lit('{"$date":{"$numberLong":"'), F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string"), F.lit('"}}'))),
        ("paid", F.lit(True), F.when(F.col("o_orderstatus") == "F", "true").otherwise("false")),
        ("address", F.lit(True), F.concat(F.lit('{"city":'), quoted(F.col("n_name")), F.lit(',"zip":'), quoted((k % 100).cast("string")), F.when(k % 6 == 0, F.lit(',"geo":{"lat":{"$numberDouble":"1.5"}}')).otherwise(""), F.lit("}"))),
        ("address_city", k % 50 == 0, F.lit('"other"')),
        ("tags", k % 7 != 0, F.lit('["a",{"$numberInt":"2"}]')),
        ("notes", (k % 11 == 0) | (k % 3 != 0), F.when(k % 11 == 0, "null").otherwise(F.lit('"note"'))),
        ("metadata", k % 5 < 2, F.lit('{"z":{"$numberInt":"1"},"a":"x"}')),
        ("blank", F.lit(True), F.lit("null")),
        ("1st-ref", F.lit(True), quoted(F.concat(F.lit("r"), k.cast("string")))),
    ]
    parts = [F.when(present, F.concat(F.lit(f'"{name}":'), value)) for name, present, value in fields]
    return orders.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("json"))


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    named = orders.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    # documents are made and parsed behind the join, which keeps few tasks as its rows are small
    return order_json(spread(named, "o_orderkey", orders.count()))


def order_documents(spark: SparkSession, d: str) -> DataFrame:
    return docs.parse_documents(order_lines(spark, d), "json")


FIELDS = [
    ("_id", "ObjectId", "true"), ("customer_id", "Int64", "true"), ("total", "Decimal128", "o_orderkey % 33 = 0"), ("total", "Double", "o_orderkey % 33 <> 0"),
    ("qty", "Int64", "o_orderkey % 4 = 0"), ("qty", "Int32", "o_orderkey % 4 <> 0"), ("code", "String", "o_orderkey % 9 = 0"), ("code", "Int32", "o_orderkey % 9 <> 0"),
    ("ordered_at", "Date", "true"), ("paid", "Boolean", "true"), ("address", "Document", "true"), ("address.city", "String", "true"), ("address.zip", "String", "true"),
    ("address.geo", "Document", "o_orderkey % 6 = 0"), ("address.geo.lat", "Double", "o_orderkey % 6 = 0"), ("address_city", "String", "o_orderkey % 50 = 0"),
    ("tags", "Array", "o_orderkey % 7 <> 0"), ("notes", "null", "o_orderkey % 11 = 0"), ("notes", "String", "o_orderkey % 11 <> 0 AND o_orderkey % 3 <> 0"),
    ("metadata", "Document", "o_orderkey % 5 < 2"), ("metadata.a", "String", "o_orderkey % 5 < 2"), ("metadata.z", "Int32", "o_orderkey % 5 < 2"), ("blank", "null", "true"), ("1st-ref", "String", "true"),
]
WALK_SQL = " UNION ALL ".join(f"SELECT '{f}' AS field_name, '{t}' AS type_name, count(*) AS n FROM orders WHERE {w}" for f, t, w in FIELDS)
FREQ_SQL = f"""SELECT field_name, CAST(coalesce(sum(n) FILTER (type_name <> 'null'), 0) AS BIGINT) AS occurrences, CAST(coalesce(sum(n) FILTER (type_name = 'null'), 0) AS BIGINT) AS null_count,
    CAST(greatest((SELECT count(*) FROM orders) - sum(n), 0) AS BIGINT) AS absent_count, (SELECT count(*) FROM orders) AS total_docs,
    coalesce(string_agg(type_name || '=' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, type_name) FILTER (type_name <> 'null'), '') AS types,
    count(*) FILTER (type_name <> 'null') > 1 AS polymorphic FROM ({WALK_SQL}) GROUP BY field_name"""


def frequencies(spark: SparkSession, d: str) -> DataFrame:
    return docs.text_frequency(order_lines(spark, d), "json")


@query("walk_documents", WALK_SQL)
def _(spark, d):
    return docs.walk_documents(order_documents(spark, d)).groupBy("field_name", "type_name").agg(F.count("*").alias("n"))


@query("field_frequency", FREQ_SQL)
def _(spark, d):
    f = frequencies(spark, d)
    return f.withColumn("types", F.array_join(F.transform("types", lambda t: F.concat(t["type_name"], F.lit("="), t["count"].cast("string"))), ",")).drop("coverage")


@query("coverage", f"SELECT field_name, round(occurrences * 100.0 / total_docs, 6) AS coverage FROM ({FREQ_SQL})")
def _(spark, d):
    return frequencies(spark, d).select("field_name", F.round("coverage", 6).alias("coverage"))


PLAN = [
    ("_id", "_id", "text", "direct", True, False), ("customer_id", "customer_id", "bigint", "direct", False, False), ("total", "total", "numeric", "direct", False, False),
    ("qty", "qty", "bigint", "direct", False, False), ("code", "code", "text", "direct", False, False), ("ordered_at", "ordered_at", "timestamptz", "direct", False, False),
    ("paid", "paid", "boolean", "direct", False, False), ("address", "address", "jsonb", "as_jsonb", False, False), ("address.city", "address_city", "text", "direct", False, True),
    ("address.zip", "address_zip", "text", "direct", False, True), ("address.geo", "address_geo", "jsonb", "as_jsonb", False, True), ("address.geo.lat", "address_geo_lat", "double precision", "direct", False, True),
    ("address_city", "address_city_2", "text", "direct", False, True), ("tags", "tags", "jsonb", "as_jsonb", False, True), ("notes", "notes", "text", "direct", False, True),
    ("metadata", "metadata", "jsonb", "as_jsonb", False, True), ("metadata.a", "metadata_a", "text", "direct", False, True), ("metadata.z", "metadata_z", "integer", "direct", False, True),
    ("blank", "blank", "text", "direct", False, True), ("1st-ref", "_1st_ref", "text", "direct", False, False),
]
# The rules of inference over the types that the orders' documents really have.
PLAN_SQL = f"""WITH f AS ({FREQ_SQL}), k AS (
    SELECT field_name, types, field_name = '_id' AS is_pk, null_count > 0 OR absent_count > 0 OR contains(field_name, '.') AS loose, polymorphic AS many, contains(types, 'String=') AS str,
        contains(types, 'Int32=') AS i32, contains(types, 'Int64=') AS i64, contains(types, 'Double=') AS dbl, contains(types, 'Decimal128=') AS dec, contains(types, 'Document=') OR contains(types, 'Array=') AS nested, split_part(types, '=', 1) AS one FROM f
), t AS (
    SELECT *, CASE WHEN types = '' THEN 'text' WHEN many AND nested THEN 'jsonb' WHEN many AND str THEN 'text' WHEN many AND dec THEN 'numeric' WHEN many AND dbl THEN 'double precision' WHEN many THEN 'bigint'
        WHEN one IN ('String', 'ObjectId') THEN 'text' WHEN one = 'Int32' THEN 'integer' WHEN one = 'Int64' THEN 'bigint' WHEN one = 'Double' THEN 'double precision' WHEN one = 'Decimal128' THEN 'numeric'
        WHEN one = 'Boolean' THEN 'boolean' WHEN one = 'Date' THEN 'timestamptz' ELSE 'jsonb' END AS pg_type FROM k
), n AS (
    SELECT *, CASE WHEN regexp_matches(field_name, '^[0-9]') THEN '_' ELSE '' END || regexp_replace(field_name, '[^A-Za-z0-9_]', '_', 'g') AS base FROM t
)
SELECT field_name, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY field_name) = 1 THEN base ELSE base || '_' || CAST(row_number() OVER (PARTITION BY base ORDER BY field_name) AS VARCHAR) END AS pg_column,
    pg_type, CASE WHEN pg_type = 'jsonb' THEN 'as_jsonb' ELSE 'direct' END AS strategy, is_pk, loose AND NOT is_pk AS nullable,
    CASE WHEN is_pk OR types = '' THEN 'text' WHEN many AND pg_type = 'numeric' AND NOT i32 AND NOT i64 THEN 'numeric,double precision,jsonb' WHEN many AND pg_type = 'numeric' THEN 'numeric,jsonb' WHEN many AND pg_type = 'jsonb' AND nested THEN 'jsonb,skip'
        WHEN many AND pg_type = 'double precision' THEN 'double precision,numeric,jsonb' WHEN many THEN pg_type || ',jsonb'
        WHEN one = 'String' THEN 'text,jsonb' WHEN one = 'Int32' THEN 'integer,bigint,text' WHEN one = 'Double' THEN 'double precision,numeric,text' WHEN one = 'Decimal128' THEN 'numeric,double precision,text'
        WHEN one = 'Array' THEN 'jsonb,skip' WHEN one = 'Document' THEN 'jsonb,flatten,skip' ELSE pg_type || ',text' END AS options
FROM n"""


def _joined_options(plan: DataFrame) -> DataFrame:
    return plan.withColumn("options", F.array_join("options", ","))


@query("infer_types", f"SELECT field_name, pg_type, strategy, is_pk, nullable, options FROM ({PLAN_SQL})")
def _(spark, d):
    return _joined_options(infer.infer_types(frequencies(spark, d))).select("field_name", "pg_type", "strategy", "is_pk", "nullable", "options")


@query("infer_schema", PLAN_SQL)
def _(spark, d):
    return _joined_options(infer.infer_schema(frequencies(spark, d)))


@query("plan_columns", f"SELECT pg_column AS column_name, pg_type AS type, nullable, is_pk FROM ({PLAN_SQL}) UNION ALL SELECT '_extra', 'jsonb', true, false")
def _(spark, d):
    return infer.plan_columns(infer.infer_schema(frequencies(spark, d)))


@query("read_documents", "SELECT lpad(lower(to_hex(o_orderkey)), 24, '0') AS doc_id, o_custkey AS customer_id FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    path = shared_path(spark, "collection")
    order_lines(spark, d).write.text(path)
    return docs.read_documents(spark, path).select("doc_id", docs.tag_text(F.col("doc"), "customer_id", "$numberLong").cast("long").alias("customer_id"))


def _rows(*names: str, strategy: dict[str, str] | None = None) -> list[dict]:
    rows = [dict(zip(("field_name", "pg_column", "pg_type", "strategy"), r, strict=False)) for r in PLAN if not names or r[0] in names]
    return [r | {"strategy": (strategy or {}).get(r["field_name"], r["strategy"])} for r in rows]


NAMED_SQL = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
DIRECT_SQL = f"""SELECT lpad(lower(to_hex(o_orderkey)), 24, '0') AS _id, o_custkey AS customer_id, CAST(CASE WHEN o_orderkey % 33 = 0 THEN 12.5 ELSE o_orderkey % 1000 + 0.5 END AS DOUBLE) AS total,
    o_orderkey % 50 AS qty, CASE WHEN o_orderkey % 9 = 0 THEN 'c' || CAST(o_orderkey AS VARCHAR) ELSE CAST(o_orderkey % 10 AS VARCHAR) END AS code, o_orderstatus = 'F' AS paid,
    'r' || CAST(o_orderkey AS VARCHAR) AS _1st_ref, CAST(NULL AS VARCHAR) AS blank, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 3 <> 0 THEN 'note' END AS notes, epoch_ms(o_orderdate) AS ordered_ms {NAMED_SQL}"""


@query("apply_plan_direct", DIRECT_SQL)
def _(spark, d):
    out = docs.apply_plan(order_documents(spark, d), _rows())
    return out.select("_id", "customer_id", F.col("total").cast("double").alias("total"), "qty", "code", "paid", "_1st_ref", "blank", "notes", F.unix_millis("ordered_at").alias("ordered_ms"))


ADDRESS_SQL = """'{"city":"' || n_name || '",' || CASE WHEN o_orderkey % 6 = 0 THEN '"geo":{"lat":1.5},' ELSE '' END || '"zip":"' || CAST(o_orderkey % 100 AS VARCHAR) || '"}'"""


@query("apply_plan_as_jsonb", f"""SELECT lpad(lower(to_hex(o_orderkey)), 24, '0') AS _id, {ADDRESS_SQL} AS address, CASE WHEN o_orderkey % 7 <> 0 THEN '["a",2]' END AS tags, CASE WHEN o_orderkey % 5 < 2 THEN '{{"a":"x","z":1}}' END AS metadata {NAMED_SQL}""")
def _(spark, d):
    return docs.apply_plan(order_documents(spark, d), _rows()).select("_id", "address", "tags", "metadata")


@query(
    "apply_plan_flatten",
    f"""SELECT lpad(lower(to_hex(o_orderkey)), 24, '0') AS _id, n_name AS address_city, CAST(o_orderkey % 100 AS VARCHAR) AS address_zip,
        CASE WHEN o_orderkey % 6 = 0 THEN '{{"address.geo":{{"lat":1.5}}}}' END AS _extra {NAMED_SQL}""",
)
def _(spark, d):
    plan = _rows("_id", "address", "address.city", "address.zip", strategy={"address": "flatten"})
    skipped = [r | {"strategy": "skip"} for r in _rows() if "." not in r["field_name"] and r["field_name"] not in ("_id", "address")]
    return docs.apply_plan(order_documents(spark, d), plan + skipped)


@query("apply_plan_skip", f"SELECT o_custkey AS customer_id, CAST(NULL AS VARCHAR) AS _extra {NAMED_SQL}")
def _(spark, d):
    plan = [r | {"strategy": "direct" if r["field_name"] == "customer_id" else "skip"} for r in _rows() if "." not in r["field_name"]]
    return docs.apply_plan(order_documents(spark, d), plan)


@query("apply_plan_extra", f"""SELECT lpad(lower(to_hex(o_orderkey)), 24, '0') AS _id, '{{"1st-ref":"r' || CAST(o_orderkey AS VARCHAR) || '","blank":null' || CASE WHEN o_orderkey % 5 < 2 THEN ',"metadata":{{"a":"x","z":1}}' ELSE '' END || ',"qty":' || CAST(o_orderkey % 50 AS VARCHAR) || '}}' AS _extra {NAMED_SQL}""")
def _(spark, d):
    return docs.apply_plan(order_documents(spark, d), [r for r in _rows() if r["field_name"] not in ("qty", "metadata", "blank", "1st-ref")]).select("_id", "_extra")


@query("bad_value_policy", f"SELECT lpad(lower(to_hex(o_orderkey)), 24, '0') AS _id, o_orderkey % 10 AS code {NAMED_SQL} WHERE o_orderkey % 9 <> 0")
def _(spark, d):
    plan = [r | {"pg_type": "integer"} if r["field_name"] == "code" else r for r in _rows("_id", "code")]
    return docs.apply_plan(order_documents(spark, d), plan, on_error="skip").select("_id", "code")


@query("rejected_documents", f"SELECT lpad(lower(to_hex(o_orderkey)), 24, '0') AS doc_id {NAMED_SQL} WHERE o_orderkey % 9 = 0")
def _(spark, d):
    plan = [r | {"pg_type": "integer"} if r["field_name"] == "code" else r for r in _rows("_id", "code")]
    return docs.rejected_documents(order_documents(spark, d), plan).select("doc_id")


def mixed_lines(spark: SparkSession, d: str) -> DataFrame:
    """json: documents with a field `_extra`, and lines that are an array, a string or broken."""
    k = F.col("o_orderkey")
    document = F.concat(F.lit('{"_extra":'), k.cast("string"), F.lit(',"b":{"c":"x"'), F.when(k % 3 == 0, F.lit(',"d":null')).otherwise(""), F.lit("}}"))
    return table(spark, d, "orders").select(F.when(k % 8 == 0, "[1,2]").when(k % 8 == 1, '"s"').when(k % 8 == 2, '{"a":').otherwise(document).alias("json"))


@query(
    "count_fields",
    """WITH o AS (SELECT o_orderkey % 3 = 0 AS more FROM orders WHERE o_orderkey % 8 > 2)
       SELECT f AS field_name, t AS type_name, count(*) AS n FROM o, (VALUES ('_extra', 'Int64'), ('b', 'Document'), ('b.c', 'String'), (NULL, 'document')) v(f, t) GROUP BY 1, 2
       UNION ALL SELECT 'b.d', 'null', count(*) FROM o WHERE more UNION ALL SELECT NULL, 'rejected', count(*) FROM orders WHERE o_orderkey % 8 <= 2""",
)
def _(spark, d):
    return docs.count_fields(mixed_lines(spark, d), "json")


@query("apply_plan_own_extra", """SELECT o_orderkey AS _extra, '{"b":{"c":"x"' || CASE WHEN o_orderkey % 3 = 0 THEN ',"d":null' ELSE '' END || '}}' AS _extra_2 FROM orders WHERE o_orderkey % 8 > 2""")
def _(spark, d):
    plan = [{"field_name": "_extra", "pg_column": "_extra", "pg_type": "bigint", "strategy": "direct"}]
    return docs.apply_plan(docs.parse_documents(mixed_lines(spark, d), "json", "_extra"), plan, on_error="skip")


@query("stream_apply_plan", "SELECT o_custkey AS customer_id, o_orderkey % 50 AS qty FROM orders")
def _(spark, d):
    orders = table(spark, d, "orders")
    # a file of few row groups would give few tasks
    stream = spread(streaming.read_stream(spark, d, "orders.parquet", orders.schema), "o_orderkey", orders.count()).withColumn("n_name", F.lit("any"))
    parsed = docs.parse_documents(order_json(stream), "json")
    return streaming.stream_append(docs.apply_plan(parsed, _rows("customer_id", "qty")).select("customer_id", "qty"), shared_path(spark, "docs"), shared_path(spark, "checkpoint"))
