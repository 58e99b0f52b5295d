"""Scans, splits, merges, sinks and integrity checks over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablebridge.operators import filemerge, integrity, merge, rangediff, sync
from tablebridge.plans import compare
from tablebridge.queries import query
from tablebridge.sources import bulktext, keyset, scan
from tablebridge.sources.shared import shared_path, stored
from tablebridge.streaming import sync as streaming

table = scan.scan_table
TARGET_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice * 0.5 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 10 < 8"
SOURCE_SQL = "SELECT * FROM orders WHERE o_orderkey % 10 >= 3"
PAIR_SQL = f"WITH t AS ({TARGET_SQL}), s AS ({SOURCE_SQL}) "


def target_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderkey % 10 < 8")
    return o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") * 0.5).otherwise(F.col("o_totalprice")))


def source_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderkey % 10 >= 3")


@query("upsert", PAIR_SQL + "SELECT * FROM s UNION ALL SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)")
def _(spark, d):
    return merge.upsert(target_orders(spark, d), source_orders(spark, d), ["o_orderkey"])


@query("replace_rows", PAIR_SQL + "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, NULL::VARCHAR AS o_orderpriority FROM s UNION ALL SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)")
def _(spark, d):
    return merge.replace_rows(target_orders(spark, d), source_orders(spark, d).drop("o_orderpriority"), ["o_orderkey"])


@query("insert_new", PAIR_SQL + "SELECT * FROM t UNION ALL SELECT * FROM s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)")
def _(spark, d):
    return merge.insert_new(target_orders(spark, d), source_orders(spark, d), ["o_orderkey"])


@query("append_unkeyed", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 2 = 0 UNION ALL SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 3 = 0")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return merge.append_unkeyed(li.where("l_orderkey % 2 = 0"), li.where("l_orderkey % 3 = 0"))


CLASH_SQL = "WITH t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS name, 'old' AS side FROM customer WHERE c_custkey % 2 = 0), s AS (SELECT c_custkey + 1000000 AS id, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS name, 'new' AS side FROM customer WHERE c_custkey % 3 = 0) "


def clashing(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, name, side) of a target and a source, with names that clash and names that are null."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_name")).alias("name"))
    return c.where("id % 2 = 0").withColumn("side", F.lit("old")), c.where("id % 3 = 0").select((F.col("id") + 1_000_000).alias("id"), "name", F.lit("new").alias("side"))


@query("append_unique_skip", CLASH_SQL + "SELECT * FROM t UNION ALL SELECT * FROM s WHERE name IS NULL OR NOT EXISTS (SELECT 1 FROM t WHERE t.name = s.name)")
def _(spark, d):
    return merge.append_unkeyed(*clashing(spark, d), unique=["name"])


@query("append_unique_update", CLASH_SQL + "SELECT * FROM t WHERE name IS NULL OR NOT EXISTS (SELECT 1 FROM s WHERE s.name = t.name) UNION ALL SELECT * FROM s")
def _(spark, d):
    return merge.append_unkeyed(*clashing(spark, d), unique=["name"], on_clash="update")


@query("truncate_reload", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_totalprice, NULL::INTEGER AS o_note FROM orders WHERE o_orderkey % 10 >= 3")
def _(spark, d):
    return merge.truncate_reload(source_orders(spark, d), T.StructType.fromDDL("o_orderkey long, o_custkey string, o_totalprice double, o_note int"))


@query("recreate_reload", SOURCE_SQL)
def _(spark, d):
    # the stored table gives way to one in the source's schema
    folder = shared_path(spark, "recreated")
    filemerge.write_files(target_orders(spark, d).drop("o_orderpriority"), folder, ["o_orderkey"], 4)
    filemerge.replace_files(spark, folder, merge.recreate_reload(source_orders(spark, d)))
    return spark.read.parquet(folder)


@query("bulk_append", SOURCE_SQL)
def _(spark, d):
    return merge.bulk_append(target_orders(spark, d).limit(0), source_orders(spark, d))


@query("coerce_for_sink", "SELECT o_orderkey, o_orderpriority AS as_text, CAST(o_orderkey AS INTEGER) AS small FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.encode("o_orderpriority", "UTF-8").alias("as_text"), F.col("o_orderkey").cast("string").alias("small"))
    return merge.coerce_for_sink(o, T.StructType.fromDDL("o_orderkey long, as_text string, small int"))


@query(
    "bulk_text_line",
    r"""SELECT CASE WHEN flag THEN '1' ELSE '0' END || chr(9) || CAST(k AS VARCHAR) || chr(9) || CASE WHEN note IS NULL THEN '\N' ELSE
        replace(replace(replace(note, '\', '\\'), chr(9), '\' || chr(9)), chr(10), '\' || chr(10)) END || chr(9) || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS line
        FROM (SELECT o_orderkey AS k, o_orderdate, o_orderstatus = 'F' AS flag,
              CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a' || chr(9) || 'b' WHEN 2 THEN 'x\y' ELSE 'l' || chr(10) || 'm' END AS note FROM orders)""",
)
def _(spark, d):
    k = F.col("o_orderkey")
    note = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, "a\tb").when(k % 4 == 2, "x\\y").otherwise("l\nm")
    return merge.bulk_text_line(table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("a_flag"), k.alias("b_key"), note.alias("c_note"), F.col("o_orderdate").alias("d_date")))


@query(
    "bulk_text_round_trip",
    r"""SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(12, 2)) AS amount, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'a' || chr(9) || 'b' WHEN 2 THEN 'x\y\' WHEN 3 THEN 'l' || chr(10) ELSE '' END AS note,
        o_orderstatus = 'F' AS flag, o_orderdate FROM orders""".replace("\\\\", "\\"),
)
def _(spark, d):
    k = F.col("o_orderkey")
    note = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "a\tb").when(k % 5 == 2, "x\\y\\").when(k % 5 == 3, "l\n").otherwise("")
    rows = table(spark, d, "orders").select(k.alias("k"), F.col("o_totalprice").cast("decimal(12,2)").alias("amount"), note.alias("note"), (F.col("o_orderstatus") == "F").alias("flag"), "o_orderdate")
    folder = shared_path(spark, "bulk")
    bulktext.write_bulk_text(rows, folder)
    return bulktext.read_bulk_text(spark, folder, rows.schema)


@query("alter_columns", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_totalprice, o_orderdate, o_orderpriority, 7 AS o_level FROM orders")
def _(spark, d):
    return merge.alter_columns(table(spark, d, "orders"), [{"kind": "add", "name": "o_level", "type": "int", "default": 7}, {"kind": "drop", "name": "o_orderstatus"}, {"kind": "alter", "name": "o_custkey", "type": "string"}])


@query("scan_table", "SELECT * FROM customer")
def _(spark, d):
    return table(spark, d, "customer")


@query("scan_pk_range", "SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
def _(spark, d):
    return scan.scan_pk_range(table(spark, d, "orders"), "o_orderkey", 100, 900)


@query("pk_bounds", "SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) AS n FROM orders")
def _(spark, d):
    return scan.pk_bounds(table(spark, d, "orders"), "o_orderkey")


@query(
    "pk_segments",
    """WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, CAST(ceil((max(o_orderkey) - min(o_orderkey) + 1) / 7.0) AS BIGINT) AS w FROM orders),
       s AS (SELECT CAST(i AS INTEGER) AS seg_id, lo + i * w AS seg_from, least(lo + i * w + w - 1, hi) AS seg_to FROM b, range(7) r(i) WHERE lo + i * w <= hi)
       SELECT seg_id, seg_from, seg_to, count(o_orderkey) AS rows FROM s LEFT JOIN orders ON o_orderkey BETWEEN seg_from AND seg_to GROUP BY ALL""",
)
def _(spark, d):
    return scan.pk_segments(table(spark, d, "orders"), "o_orderkey", 7)


@query(
    "offset_segments",
    """SELECT o_orderkey, position, CAST(position // (SELECT CAST(ceil(count(*) / 4.0) AS BIGINT) FROM orders) AS INTEGER) AS seg_id
       FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS position FROM orders)""",
)
def _(spark, d):
    return scan.offset_segments(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], 4).select("o_orderkey", "position", "seg_id")


@query("keyset_page", "SELECT * FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 1000")
def _(spark, d):
    return scan.keyset_page(table(spark, d, "orders"), "o_orderkey", 500)


@query(
    "keyset_token",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS as_long, CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 24, '0') END AS as_object_id,
       CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 <> 0 THEN 'k' || CAST(o_orderkey AS VARCHAR) END AS as_text FROM orders""",
)
def _(spark, d):
    k = F.col("o_orderkey")
    token = F.when(k % 2 == 0, scan.encode_key(k)).when(k % 3 == 0, F.lpad(scan.encode_key(k), 24, "0")).otherwise(F.concat(F.lit("k"), scan.encode_key(k)))
    return table(spark, d, "orders").select("o_orderkey", scan.decode_key(token, F.when(k % 2 == 0, "bigint").otherwise("text")).alias("t")).select("o_orderkey", "t.*")


@query(
    "batch_manifest",
    """SELECT CAST(p // 1000 + 1 AS BIGINT) AS batch_id, count(*) AS rows_in_batch, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, CAST(max(p) + 1 AS BIGINT) AS rows_cum
       FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) GROUP BY 1""",
)
def _(spark, d):
    return scan.batch_manifest(table(spark, d, "orders"), "o_orderkey")


NAMES = ["customer", "orders", "lineitem", "part", "supplier"]
COUNTS_SQL = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in NAMES)


def _counts(spark, d):
    return scan.row_counts({n: table(spark, d, n) for n in NAMES})


@query("row_counts", COUNTS_SQL)
def _(spark, d):
    return _counts(spark, d)


@query("sample_size", f"SELECT table_name, rows, CAST(CASE WHEN rows < 1000 THEN 2000 ELSE least(greatest(floor(rows * 5.0 / 100), 1), 2500) END AS BIGINT) AS sample_n FROM ({COUNTS_SQL})")
def _(spark, d):
    return scan.sample_size(_counts(spark, d), percent=5.0, threshold=1000, most=2500)


@query(
    "sample_documents",
    "SELECT count(*) AS n, count(DISTINCT s.o_orderkey) AS different, bool_and(o.o_orderkey IS NOT NULL AND o.o_custkey = s.o_custkey AND o.o_totalprice = s.o_totalprice) AS own, true AS lowest FROM (SELECT * FROM orders LIMIT 500) s LEFT JOIN orders o USING (o_orderkey)",
)
def _(spark, d):
    orders = table(spark, d, "orders")
    sample = scan.sample_documents(orders, "o_orderkey", 500, spare=50)
    # each row is one of the table's, and as many rows hash at most as high as the highest of the sample
    same = orders.select("o_orderkey", F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("p"))
    h = F.xxhash64(F.lit(42), "o_orderkey")
    told = sample.join(same, "o_orderkey", "left").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("different"), F.bool_and((F.col("c") == F.col("o_custkey")) & (F.col("p") == F.col("o_totalprice"))).alias("own"), F.max(h).alias("top"))
    upto = orders.select(h.alias("h")).join(F.broadcast(told.select("top")), F.col("h") <= F.col("top")).agg(F.count("*").alias("upto"))
    return told.crossJoin(upto).select("n", "different", "own", (F.col("upto") == F.col("n")).alias("lowest"))


def _listing(spark, d):
    kinds = F.when(F.col("event_type") == "view", "view").otherwise("collection")
    name = F.concat(F.when(F.col("user_id") % 7 == 0, "system.").otherwise(""), "event_type", F.col("user_id").cast("string"), F.when(F.col("user_id") % 5 == 0, ".files").when(F.col("user_id") % 3 == 0, ".chunks").otherwise(""))
    return table(spark, d, "events").select(name.alias("name"), kinds.alias("kind")).distinct()


@query(
    "filter_collections",
    """SELECT DISTINCT event_type || CAST(user_id AS VARCHAR) AS name, 'collection' AS kind FROM events WHERE event_type <> 'view' AND user_id % 7 <> 0 AND user_id % 5 <> 0 AND user_id % 3 <> 0""",
)
def _(spark, d):
    return scan.filter_collections(_listing(spark, d))


@query("select_tables", "SELECT table_name, rows FROM (" + COUNTS_SQL + ") WHERE table_name IN ('orders', 'part')")
def _(spark, d):
    return scan.select_tables(_counts(spark, d), spark.createDataFrame([("public.Orders",), (" PART ",), ("nothing",)], "name string"))


@query("missing_tables", "SELECT c_mktsegment AS name FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def _(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct().union(spark.createDataFrame([("dbo.ORDERS",)], "name string"))
    return scan.missing_tables(_counts(spark, d), asked)


@query("list_tables", "SELECT 'part_' || lower(p_brand) AS table_name FROM (SELECT DISTINCT replace(p_brand, '#', '_') AS p_brand FROM part)")
def _(spark, d):
    # a catalog database of one table a brand, made of the part table
    name = "listed_" + uuid.uuid4().hex
    spark.sql(f"CREATE DATABASE {name}")
    try:
        for (brand,) in table(spark, d, "part").select(F.regexp_replace("p_brand", "#", "_")).distinct().collect():
            spark.sql(f"CREATE TABLE {name}.part_{brand} (p_partkey BIGINT) USING parquet")
        return stored(scan.list_tables(spark, name), "listed")
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


@query("table_inventory", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows, true AS stored, true AS sized FROM {n}" for n in NAMES))
def _(spark, d):
    found = scan.table_inventory(spark, {n: f"{d}/{n}.parquet" for n in NAMES}).join(_counts(spark, d), "table_name")
    fits = F.col("size_human").endswith("B") & (F.regexp_extract("size_human", r"^([0-9.]+) ", 1).cast("double") * F.element_at(F.create_map(*(F.lit(x) for kv in (("B", 1.0), ("KB", 1024.0), ("MB", 1048576.0), ("GB", 1073741824.0)) for x in kv)), F.substring_index("size_human", " ", -1)) >= F.col("size_bytes") * 0.5)
    return found.select("table_name", "rows", (F.col("files") > 0).alias("stored"), fits.alias("sized"))


@query("estimated_counts", COUNTS_SQL)
def _(spark, d):
    return scan.estimated_counts(spark, {n: f"{d}/{n}.parquet" for n in NAMES})


@query("database_inventory", f"SELECT 'driver' AS database, CAST({len(NAMES)} AS BIGINT) AS tables, CAST(sum(rows) AS BIGINT) AS rows, true AS adds_up FROM ({COUNTS_SQL})")
def _(spark, d):
    tables = scan.table_inventory(spark, {n: f"{d}/{n}.parquet" for n in NAMES})
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load([f"{d}/{n}.parquet" for n in NAMES]).agg(F.sum("length").alias("bytes"), F.count("*").alias("n"))
    total = scan.database_inventory(tables, "driver").crossJoin(listed).crossJoin(_counts(spark, d).agg(F.sum("rows").alias("rows")))  # one row each
    return total.select("database", "tables", "rows", ((F.col("bytes") == F.col("size_bytes")) & (F.col("n") == F.col("files"))).alias("adds_up"))


@query("check_primary_key", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return integrity.check_primary_key(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("check_unique", "SELECT l_partkey, l_suppkey, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return integrity.check_unique(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


DEFECTS_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 101 = 0 THEN -1.0 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders"


def _defects(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.when(k % 97 == 0, F.col("o_custkey") + 1000000).otherwise(F.col("o_custkey")).alias("o_custkey"),
        F.when(k % 101 == 0, -1.0).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(k % 89 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
    )


@query("check_foreign_key", f"SELECT * FROM ({DEFECTS_SQL}) o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o.o_custkey)")
def _(spark, d):
    return integrity.check_foreign_key(_defects(spark, d), ["o_custkey"], table(spark, d, "customer"), ["c_custkey"])


@query("check_expression", f"SELECT * FROM ({DEFECTS_SQL}) WHERE NOT (o_totalprice > 0)")
def _(spark, d):
    return integrity.check_expression(_defects(spark, d), "o_totalprice > 0")


@query("check_not_null", f"SELECT 'o_orderkey' AS column_name, CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'o_orderpriority', count(*) FROM ({DEFECTS_SQL}) WHERE o_orderpriority IS NULL")
def _(spark, d):
    return integrity.check_not_null(_defects(spark, d), ["o_orderkey", "o_orderpriority"])


CONSTRAINTS = [
    {"table": "orders", "name": "pk", "kind": "primary_key", "columns": ["o_orderkey"]},
    {"table": "orders", "name": "fk", "kind": "foreign_key", "columns": ["o_custkey"], "references": ("customer", ["c_custkey"])},
    {"table": "orders", "name": "positive", "kind": "check", "sql": "o_totalprice > 0"},
    {"table": "orders", "name": "filled", "kind": "not_null", "columns": ["o_orderpriority"]},
    {"table": "customer", "name": "names", "kind": "unique", "columns": ["c_name"]},
]


@query(
    "check_constraints",
    f"""WITH o AS ({DEFECTS_SQL})
        SELECT 'orders' AS table_name, 'pk' AS name, 'primary_key' AS kind, CAST(0 AS BIGINT) AS violations
        UNION ALL SELECT 'orders', 'fk', 'foreign_key', count(*) FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT 'orders', 'filled', 'not_null', count(*) FROM o WHERE o_orderpriority IS NULL
        UNION ALL SELECT 'customer', 'names', 'unique', count(*) FROM (SELECT c_name FROM customer GROUP BY 1 HAVING count(*) > 1)""",
)
def _(spark, d):
    done = spark.createDataFrame([("orders", "positive")], "table_name string, name string")
    return integrity.check_constraints({"orders": _defects(spark, d), "customer": table(spark, d, "customer")}, CONSTRAINTS, done)


@query(
    "reconcile_counts",
    "SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM orders WHERE o_orderkey % 10 < 8) AS target_rows, (SELECT count(*) FROM orders WHERE o_orderkey % 10 >= 8) > 0 AS mismatch"
    " UNION ALL SELECT 'customer', count(*), count(*), false FROM customer",
)
def _(spark, d):
    c = table(spark, d, "customer")
    return integrity.reconcile_counts(scan.row_counts({"orders": table(spark, d, "orders"), "customer": c}), scan.row_counts({"orders": target_orders(spark, d), "customer": c}))


DIFF_SQL = (
    PAIR_SQL
    + """SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN 'missing' WHEN s.o_orderkey IS NULL THEN 'extra' ELSE 'changed' END AS status,
         CASE WHEN s.o_orderkey IS NOT NULL AND t.o_orderkey IS NOT NULL THEN 'o_totalprice' ELSE '' END AS changed_columns
         FROM s FULL JOIN t ON s.o_orderkey = t.o_orderkey WHERE s.o_orderkey IS NULL OR t.o_orderkey IS NULL OR s.o_totalprice <> t.o_totalprice"""
)


@query("diff_rows", DIFF_SQL)
def diff_rows(spark, d):
    return integrity.diff_rows(source_orders(spark, d), target_orders(spark, d), ["o_orderkey"], ["o_custkey", "o_totalprice", "o_orderpriority"])


@query("diff_ranges", DIFF_SQL)
def _(spark, d):
    return rangediff.diff_ranges(source_orders(spark, d), target_orders(spark, d), ["o_orderkey"], ["o_custkey", "o_totalprice", "o_orderpriority"], leaf_rows=1000)


@query("sync_tables", f"SELECT 'customer' AS table_name, 'completed' AS status, count(*) AS rows, CAST(0 AS BIGINT) AS violations, true AS clean FROM customer UNION ALL SELECT 'orders', 'completed', count(*), CAST(0 AS BIGINT), true FROM orders UNION ALL SELECT 'broken', 'failed', CAST(0 AS BIGINT), CAST(0 AS BIGINT), false")
def _(spark, d):
    root = shared_path(spark, "sync")
    tables = [
        {"name": "customer", "source": table(spark, d, "customer"), "keys": ["c_custkey"]},
        {"name": "orders", "source": source_orders(spark, d), "target": target_orders(spark, d), "keys": ["o_orderkey"]},
        {"name": "broken", "source": table(spark, d, "part"), "target": table(spark, d, "part"), "keys": ["no_such_column"]},
    ]
    told = sync.sync_tables(spark, tables, lambda n, df: df.write.parquet(f"{root}/{n}"), read=lambda n: spark.read.parquet(f"{root}/{n}"), constraints=[{"table": "orders", "name": "pk", "kind": "primary_key", "columns": ["o_orderkey"]}], strict=False)
    return told.select("table_name", "status", "rows", "violations", F.col("error").isNull().alias("clean"))


@query(
    "resume_tables",
    f"""SELECT 'customer' AS table_name, 1 AS loads, count(*) AS rows, CAST(0 AS BIGINT) AS violations FROM customer
        UNION ALL SELECT 'orders', 2, count(*), CAST(count_if(NOT o_totalprice > 0) + count_if(o_orderpriority IS NULL) AS BIGINT) FROM ({DEFECTS_SQL}) UNION ALL SELECT 'part', 1, count(*), CAST(0 AS BIGINT) FROM part""",
)
def _(spark, d):
    # a run in which the second table fails when it is first written, and which is then taken up again
    root, loads = shared_path(spark, "resumed"), {}
    tables = [{"name": n, "source": table(spark, d, n)} for n in ("customer", "part")] + [{"name": "orders", "source": _defects(spark, d)}]
    ledger = sync.Ledger(spark, f"{root}/ledger", "run")

    def write(name: str, df: DataFrame) -> None:
        loads[name] = loads.get(name, 0) + 1
        if name == "orders" and loads[name] == 1:
            raise OSError("no space")
        df.write.parquet(f"{root}/{name}")

    for _ in range(2):
        told = sync.sync_tables(spark, tables, write, mode="recreate", constraints=CONSTRAINTS[2:4], read=lambda n: spark.read.parquet(f"{root}/{n}"), ledger=ledger, strict=False)
    return told.join(spark.createDataFrame(list(loads.items()), "table_name string, loads int"), "table_name").select("table_name", "loads", "rows", "violations")


VERSIONS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + v AS o_totalprice, o_orderdate, o_orderpriority, v FROM orders, range(1, 6) r(v) WHERE o_orderkey % 10 >= 3 AND o_orderkey % v = 0"


def order_versions(spark: SparkSession, d: str) -> DataFrame:
    """Up to five versions v of each order, v raising its price."""
    v = F.col("v")
    rows = table(spark, d, "orders").where("o_orderkey % 10 >= 3").withColumn("v", F.explode(F.sequence(F.lit(1), F.lit(5)))).where("o_orderkey % v = 0")
    return rows.withColumn("o_totalprice", F.col("o_totalprice") + v)


@query(
    "stream_sync",
    f"""WITH t AS ({TARGET_SQL}), s AS (SELECT * FROM ({VERSIONS_SQL}) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY v DESC) = 1)
        SELECT * EXCLUDE (v) FROM s UNION ALL SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)""",
)
def _(spark, d):
    # versions of a key lie in several files and several times in one, in no order: each file is a micro-batch
    rows, folder = order_versions(spark, d), shared_path(spark, "versions")
    rows.repartition(6, "o_custkey", "v").write.parquet(folder)
    stream = streaming.read_stream(spark, folder, "*.parquet", rows.schema)
    return streaming.stream_sync(stream, target_orders(spark, d), shared_path(spark, "target"), ["o_orderkey"], shared_path(spark, "checkpoint"), "v", width=2)


@query("stream_keyset", "SELECT o_orderkey, o_custkey, o_orderdate, CAST(CASE WHEN o_orderkey * 2 <= (SELECT max(o_orderkey) FROM orders) THEN 0 ELSE 1 END AS BIGINT) AS batch FROM orders")
def _(spark, d):
    # a table that grows between two runs of one stream: the second run reads what is after the first one's last key
    orders, folder = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), shared_path(spark, "growing")
    middle = orders.agg((F.max("o_orderkey") / 2).alias("m")).first()["m"]
    out, checkpoint = shared_path(spark, "copied"), shared_path(spark, "checkpoint")

    def step(batch: DataFrame, i: int) -> None:
        batch.withColumn("batch", F.lit(i).cast("long")).write.mode("append").parquet(out)

    for part in (orders.where(F.col("o_orderkey") <= middle), orders.where(F.col("o_orderkey") > middle)):
        part.repartitionByRange(4, "o_orderkey").write.mode("append").parquet(folder)
        keyset.stream_keyset(spark, folder, "o_orderkey").writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("merge_files", f"WITH t AS ({TARGET_SQL}), s AS (SELECT * FROM ({VERSIONS_SQL}) WHERE o_orderkey < 2000 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY v DESC) = 1) SELECT * EXCLUDE (v) FROM s UNION ALL SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)")
def _(spark, d):
    folder = shared_path(spark, "files")
    filemerge.write_files(target_orders(spark, d), folder, ["o_orderkey"], 16)
    filemerge.merge_files(spark, folder, order_versions(spark, d).where("o_orderkey < 2000"), ["o_orderkey"], "v")
    return spark.read.parquet(folder)


INTROSPECTED = [
    ("region", "r_regionkey", "int", False, True, 1), ("region", "r_name", "string", True, False, 2),
    ("nation", "n_nationkey", "int", False, True, 1), ("nation", "n_name", "string", True, False, 2), ("nation", "n_regionkey", "int", True, False, 3),
]


@query("introspect_columns", f"SELECT t.*, rows FROM (VALUES {', '.join(map(str, INTROSPECTED))}) t(table_name, column_name, type, nullable, is_pk, ordinal) JOIN (SELECT 'region' AS table_name, count(*) AS rows FROM region UNION ALL SELECT 'nation', count(*) FROM nation) USING (table_name)")
def _(spark, d):
    rows = [r for n, k in (("region", "r_regionkey"), ("nation", "n_nationkey")) for r in compare.introspect_columns(n, table(spark, d, n), [k])]
    columns = spark.createDataFrame(rows, "table_name string, column_name string, type string, nullable boolean, is_pk boolean, ordinal int, default string").drop("default")
    return columns.join(scan.row_counts({n: table(spark, d, n) for n in ("region", "nation")}), "table_name")


@query(
    "choose_split",
    """SELECT p_brand || CAST(p_size % 5 AS VARCHAR) AS table_name, CASE WHEN count(*) = 1 AND bool_and(p_partkey % 2 = 0) THEN 'pk_range' ELSE 'offset' END AS mode,
       CASE WHEN count(*) = 1 AND bool_and(p_partkey % 2 = 0) THEN 'c' || CAST(min(p_partkey) AS VARCHAR) END AS pk_col FROM part GROUP BY 1""",
)
def _(spark, d):
    kind = F.when(F.col("p_partkey") % 2 == 0, "BIGINT (20) unsigned").otherwise("varchar(10)")
    columns = table(spark, d, "part").select(F.concat("p_brand", (F.col("p_size") % 5).cast("string")).alias("table_name"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("column_name"), kind.alias("type"), F.lit(True).alias("is_pk"))
    return scan.choose_split(columns, 4)
