"""Plan store, schema comparison, type maps and catalog assembly, over rows derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablebridge.plans import compare, infer, store
from tablebridge.queries import query
from tablebridge.sources.scan import scan_table as table

# A plan of the size of part: collection = brand, field = key; overridden where the key is a multiple of 4.
CURRENT_SQL = "SELECT 'p' || CAST(p_size % 3 AS VARCHAR) AS project_id, p_brand AS collection, 'f' || CAST(p_partkey AS VARCHAR) AS field_name, 'c' || CAST(p_partkey AS VARCHAR) AS pg_column, 'text' AS pg_type, 'direct' AS strategy, false AS is_pk, true AS nullable, p_partkey % 4 = 0 AS overridden FROM part WHERE p_partkey % 5 <> 0"
INFERRED_SQL = "SELECT 'p' || CAST(p_size % 3 AS VARCHAR) AS project_id, p_brand AS collection, 'f' || CAST(p_partkey AS VARCHAR) AS field_name, 'd' || CAST(p_partkey AS VARCHAR) AS pg_column, 'bigint' AS pg_type, 'as_jsonb' AS strategy, false AS is_pk, false AS nullable FROM part WHERE p_partkey % 3 <> 0"
KEYED = "USING (project_id, collection, field_name)"


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("p"), (F.col("p_size") % 3).cast("string")).alias("project_id"), F.col("p_brand").alias("collection"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("field_name"))


def current_plan(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = _keys(spark, d).where(k % 5 != 0)
    return rows.select("project_id", "collection", "field_name", F.concat(F.lit("c"), k.cast("string")).alias("pg_column"), F.lit("text").alias("pg_type"), F.lit("direct").alias("strategy"), F.lit(False).alias("is_pk"), F.lit(True).alias("nullable"), (k % 4 == 0).alias("overridden"))


def inferred_plan(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return _keys(spark, d).where(k % 3 != 0).select("project_id", "collection", "field_name", F.concat(F.lit("d"), k.cast("string")).alias("pg_column"), F.lit("bigint").alias("pg_type"), F.lit("as_jsonb").alias("strategy"), F.lit(False).alias("is_pk"), F.lit(False).alias("nullable"))


def _picked(column: str) -> str:
    return f"CASE WHEN c.overridden OR i.pg_column IS NULL THEN c.{column} ELSE i.{column} END AS {column}"


@query("merge_plan", f"SELECT project_id, collection, field_name, {', '.join(map(_picked, store.VALUES))}, coalesce(c.overridden, false) AS overridden FROM ({CURRENT_SQL}) c FULL JOIN ({INFERRED_SQL}) i {KEYED}")
def _(spark, d):
    return store.merge_plan(current_plan(spark, d), inferred_plan(spark, d))


OVERRIDES_SQL = "SELECT 'p' || CAST(p_size % 3 AS VARCHAR) AS project_id, p_brand AS collection, 'f' || CAST(p_partkey AS VARCHAR) AS field_name, 'numeric' AS pg_type FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 2 = 0"


def _overrides(spark, d):
    k = F.col("p_partkey")
    strategy = F.when(k % 2 == 0, F.lit(None).cast("string")).otherwise("explode")
    null = F.lit(None)
    return _keys(spark, d).where(k % 7 == 0).select("project_id", "collection", "field_name", null.cast("string").alias("pg_column"), F.lit("numeric").alias("pg_type"), strategy.alias("strategy"), null.cast("boolean").alias("is_pk"), null.cast("boolean").alias("nullable"))


@query("override_plan", f"SELECT project_id, collection, field_name, c.pg_column, coalesce(o.pg_type, c.pg_type) AS pg_type, c.strategy, c.is_pk, c.nullable, o.pg_type IS NOT NULL OR coalesce(c.overridden, false) AS overridden FROM ({CURRENT_SQL}) c FULL JOIN ({OVERRIDES_SQL}) o {KEYED}")
def _(spark, d):
    return store.override_plan(current_plan(spark, d), _overrides(spark, d))


@query("rejected_overrides", "SELECT 'f' || CAST(p_partkey AS VARCHAR) AS field_name FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 2 = 1")
def _(spark, d):
    return store.rejected_overrides(_overrides(spark, d)).select("field_name")


@query("parse_overrides", "SELECT p_brand AS collection, 'a.f' || CAST(p_partkey AS VARCHAR) AS field_name, CASE WHEN p_partkey % 2 = 1 THEN 'numeric(10,2)' END AS pg_type, CASE WHEN p_partkey % 2 = 1 THEN 'direct' ELSE 'skip' END AS strategy FROM part WHERE p_partkey % 3 <> 0")
def _(spark, d):
    k = F.col("p_partkey")
    good = F.concat("p_brand", F.lit(".a.f"), k.cast("string"), F.lit("="), F.when(k % 2 == 1, "numeric(10,2)").otherwise("skip"))
    return store.parse_overrides(table(spark, d, "part").select(F.when(k % 3 != 0, good).otherwise("nothing").alias("spec")))


@query("reset_plan", f"SELECT * FROM ({CURRENT_SQL}) WHERE NOT (project_id = 'p1' AND collection = (SELECT min(p_brand) FROM part))")
def _(spark, d):
    plan = current_plan(spark, d)
    return store.reset_plan(plan, "p1", table(spark, d, "part").agg(F.min("p_brand")).first()[0])


@query("freeze_plan", CURRENT_SQL)
def _(spark, d):
    return store.frozen_plan(store.freeze_plan(current_plan(spark, d)))


@query("plan_views", f"SELECT DISTINCT project_id, collection FROM ({CURRENT_SQL})")
def _(spark, d):
    return store.plan_collections(current_plan(spark, d))


@query("plan_for", f"SELECT * FROM ({CURRENT_SQL}) WHERE project_id = 'p1' AND collection = (SELECT min(p_brand) FROM part)")
def _(spark, d):
    return store.plan_for(current_plan(spark, d), "p1", table(spark, d, "part").agg(F.min("p_brand")).first()[0])


@query("override_columns", "SELECT p_brand AS table_name, 'f' || CAST(p_partkey AS VARCHAR) AS column_name, CASE WHEN p_partkey % 3 <> 0 THEN 'bigint' ELSE 'varchar' END AS type, p_partkey % 3 = 0 AS nullable, false AS is_pk FROM part")
def _(spark, d):
    columns = _keys(spark, d).select(F.col("collection").alias("table_name"), F.col("field_name").alias("column_name"), F.lit("varchar").alias("type"), F.lit(True).alias("nullable"), F.lit(False).alias("is_pk"))
    return store.override_columns(columns, inferred_plan(spark, d))


@query("column_names", "SELECT field_name, CASE WHEN r = 1 THEN b ELSE b || '_' || CAST(r AS VARCHAR) END AS pg_column FROM (SELECT f AS field_name, b, row_number() OVER (PARTITION BY b ORDER BY f) AS r FROM (SELECT p_name || sep || CAST(p_size AS VARCHAR) AS f, regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') || '_' || CAST(p_size AS VARCHAR) AS b FROM (SELECT DISTINCT p_name, p_size FROM part), (VALUES ('.'), ('-'), (' ')) s(sep)))")
def _(spark, d):
    names = table(spark, d, "part").select("p_name", "p_size").distinct().select(F.explode(F.array(*(F.concat("p_name", F.lit(s), F.col("p_size").cast("string")) for s in (".", "-", " ")))).alias("field_name"))
    return infer.column_names(names).select("field_name", "pg_column")


# Column lists: a source of the size of part in MySQL types, and a target that misses some.
TYPES = ["int(11)", "varchar(20)", "tinyint(1)", "datetime", "double", "mediumtext", "int", "set('a')", "bit(4)", "decimal(10,2)"]
TYPE_SQL = "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{t.replace(chr(39), chr(39) * 2)}'" for i, t in enumerate(TYPES)) + " END"
SOURCE_SQL = f"SELECT p_brand || CAST(p_size AS VARCHAR) AS table_name, 'c' || CAST(p_partkey AS VARCHAR) AS column_name, {TYPE_SQL} AS type FROM part"
TARGET_SQL = f"SELECT p_brand || CAST(p_size AS VARCHAR) AS table_name, 'c' || CAST(p_partkey AS VARCHAR) AS column_name, CASE WHEN p_partkey % 3 = 0 THEN 'text' ELSE {TYPE_SQL} END AS type FROM part WHERE p_size % 4 <> 0 AND p_partkey % 6 <> 1"


def source_columns(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.concat("p_brand", F.col("p_size").cast("string")).alias("table_name"), F.concat(F.lit("c"), k.cast("string")).alias("column_name"), F.get(F.array(*map(F.lit, TYPES)), (k % 10).cast("int")).alias("type"), k.alias("_k"), F.col("p_size").alias("_s"))


def target_columns(spark: SparkSession, d: str) -> DataFrame:
    s = source_columns(spark, d).where("_s % 4 <> 0 AND _k % 6 <> 1")
    return s.select("table_name", "column_name", F.when(F.col("_k") % 3 == 0, "text").otherwise(F.col("type")).alias("type"))


ISSUES_SQL = f"""WITH s AS ({SOURCE_SQL}), t AS ({TARGET_SQL}), have AS (SELECT DISTINCT table_name FROM t)
    SELECT DISTINCT table_name, '' AS column_name, 'missing_table' AS kind, 'error' AS severity, 'create table ' || table_name || ' in the target' AS suggestion FROM s WHERE table_name NOT IN (SELECT table_name FROM have)
    UNION ALL SELECT s.table_name, s.column_name, CASE WHEN t.type IS NULL THEN 'missing_column' ELSE 'type_mismatch' END, CASE WHEN t.type IS NULL THEN 'error' ELSE 'warning' END,
        CASE WHEN t.type IS NULL THEN 'add column ' || s.table_name || '.' || s.column_name || ' of type ' || s.type ELSE 'check the cast of ' || s.table_name || '.' || s.column_name || ' from ' || s.type || ' to ' || t.type END
    FROM s LEFT JOIN t ON s.table_name = t.table_name AND s.column_name = t.column_name WHERE s.table_name IN (SELECT table_name FROM have) AND (t.type IS NULL OR t.type <> s.type)"""


def issues(spark, d):
    return compare.compare_schemas(source_columns(spark, d), target_columns(spark, d))


@query("compare_schemas", f"SELECT table_name, column_name, kind, severity FROM ({ISSUES_SQL})")
def _(spark, d):
    return issues(spark, d).drop("suggestion")


@query("suggestions", ISSUES_SQL)
def _(spark, d):
    return issues(spark, d)


@query("compatibility", f"SELECT s.table_name, CAST(count(i.kind) AS BIGINT) AS issues, CAST(count(i.kind) FILTER (i.severity = 'error') AS BIGINT) AS errors, count(i.kind) FILTER (i.severity = 'error') = 0 AS compatible FROM (SELECT DISTINCT table_name FROM ({SOURCE_SQL})) s LEFT JOIN ({ISSUES_SQL}) i USING (table_name) GROUP BY 1")
def _(spark, d):
    return compare.compatibility(issues(spark, d), source_columns(spark, d).select("table_name").distinct())


MAPPED_SQL = "CASE p_partkey % 10 WHEN 0 THEN 'integer' WHEN 1 THEN 'varchar(20)' WHEN 2 THEN 'boolean' WHEN 3 THEN 'timestamp' WHEN 4 THEN 'double precision' WHEN 5 THEN 'text' WHEN 6 THEN 'integer' WHEN 7 THEN 'text' WHEN 8 THEN 'bit(4)' ELSE 'decimal(10,2)' END"


@query("map_types", f"SELECT 'c' || CAST(p_partkey AS VARCHAR) AS column_name, {MAPPED_SQL} AS type FROM part")
def _(spark, d):
    return source_columns(spark, d).select("column_name", compare.map_type(F.col("type")).alias("type"))


@query("spark_types", "SELECT 'c' || CAST(p_partkey AS VARCHAR) AS column_name, CASE p_partkey % 10 WHEN 0 THEN 'int' WHEN 1 THEN 'string' WHEN 2 THEN 'boolean' WHEN 3 THEN 'timestamp' WHEN 4 THEN 'double' WHEN 5 THEN 'string' WHEN 6 THEN 'int' WHEN 7 THEN 'string' WHEN 8 THEN 'string' ELSE 'decimal(10,2)' END AS type FROM part")
def _(spark, d):
    # the types of a catalog are few; a map of the different ones is made on the driver
    columns = source_columns(spark, d)
    known = {r[0]: compare.to_spark_type(r[0]).simpleString() for r in columns.select("type").distinct().collect()}
    return columns.select("column_name", F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), F.col("type")).alias("type"))


@query("side_by_side", f"SELECT table_name, column_name, s.type AS source_type, t.type AS target_type, CASE WHEN k % 5 = 0 THEN 'numeric' END AS planned_type, CASE WHEN k % 5 = 0 THEN 'direct' END AS strategy FROM ({SOURCE_SQL}) s FULL JOIN ({TARGET_SQL}) t USING (table_name, column_name) LEFT JOIN (SELECT 'c' || CAST(p_partkey AS VARCHAR) AS column_name, p_partkey AS k FROM part) USING (column_name)")
def _(spark, d):
    columns = source_columns(spark, d)
    plan = columns.where("_k % 5 = 0").select(F.col("table_name").alias("collection"), F.col("column_name").alias("field_name"), F.lit("numeric").alias("pg_type"), F.lit("direct").alias("strategy"))
    return compare.side_by_side(columns, target_columns(spark, d), plan)


@query(
    "create_table",
    f"""SELECT table_name, 'CREATE TABLE IF NOT EXISTS "' || table_name || '" (' || string_agg('"' || c || '" ' || t || CASE WHEN k % 2 = 0 THEN ' NOT NULL' ELSE '' END || CASE WHEN k % 3 = 0 THEN ' DEFAULT ' || CAST(k AS VARCHAR) ELSE '' END, ', ' ORDER BY k)
        || coalesce(', PRIMARY KEY (' || string_agg('"' || c || '"', ', ' ORDER BY k) FILTER (k % 8 = 0) || ')', '') || ')' AS ddl
        FROM (SELECT p_brand || CAST(p_size AS VARCHAR) AS table_name, 'c' || CAST(p_partkey AS VARCHAR) AS c, p_partkey AS k, {MAPPED_SQL} AS t FROM part) GROUP BY 1""",
)
def _(spark, d):
    c = source_columns(spark, d)
    return compare.render_ddl(c.select("table_name", "column_name", "type", (F.col("_k") % 2 == 1).alias("nullable"), (F.col("_k") % 8 == 0).alias("is_pk"), F.col("_k").alias("ordinal"), F.when(F.col("_k") % 3 == 0, F.col("_k").cast("string")).alias("default")))


@query("assemble_indexes", "SELECT t AS table_name, CASE WHEN auto THEN 'uq_' || t || '_' || string_agg(c, '_' ORDER BY k) ELSE i END AS index_name, u AS is_unique, string_agg(c, ',' ORDER BY k) AS columns FROM (SELECT p_brand AS t, CASE WHEN p_size % 2 = 0 THEN 'sqlite_autoindex_' ELSE 'ix_' END || CAST(p_size AS VARCHAR) AS i, p_size % 2 = 0 AS auto, p_size % 3 = 0 AS u, 'c' || CAST(p_partkey AS VARCHAR) AS c, p_partkey AS k FROM part WHERE p_partkey % 5 <> 0) GROUP BY t, i, auto, u")
def _(spark, d):
    s = F.col("p_size")
    rows = table(spark, d, "part").select(F.col("p_brand").alias("table_name"), F.concat(F.when(s % 2 == 0, "sqlite_autoindex_").otherwise("ix_"), s.cast("string")).alias("index_name"), (s % 3 == 0).alias("is_unique"), F.col("p_partkey").alias("position"), F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("c"), F.col("p_partkey").cast("string"))).alias("column_name"))
    return compare.assemble_indexes(rows)


@query("assemble_foreign_keys", "SELECT p_brand AS table_name, 'fk_' || CAST(p_size AS VARCHAR) AS constraint_name, string_agg('c' || CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS columns, 'parent' AS ref_table, string_agg('r' || CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS ref_columns FROM part GROUP BY 1, 2")
def _(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(F.col("p_brand").alias("table_name"), F.concat(F.lit("fk_"), F.col("p_size").cast("string")).alias("constraint_name"), F.lit("parent").alias("ref_table"), k.alias("position"), F.concat(F.lit("c"), k.cast("string")).alias("column_name"), F.concat(F.lit("r"), k.cast("string")).alias("ref_column"))
    return compare.assemble_foreign_keys(rows)


@query("list_checks", "SELECT p_partkey, p_name || ' > 0' AS clause FROM part WHERE p_partkey % 2 = 1")
def _(spark, d):
    return compare.list_checks(table(spark, d, "part").select("p_partkey", F.concat("p_name", F.when(F.col("p_partkey") % 2 == 1, " > 0").otherwise(" IS NOT NULL")).alias("clause")))


@query(
    "translate_indexes",
    """SELECT 'ix' || CAST(p_partkey AS VARCHAR) AS name, CASE WHEN p_partkey % 6 IN (0, 1) THEN 'col_a,col_b' END AS columns, p_partkey % 2 = 0 AS is_unique, p_partkey % 6 NOT IN (0, 1) AS skipped,
       CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'descending order is not kept' WHEN 2 THEN 'TTL index' WHEN 3 THEN 'hashed index' WHEN 4 THEN 'nested field a.x' ELSE 'field not in plan zz' END AS warning FROM part""",
)
def _(spark, d):
    k = F.col("p_partkey")
    key = lambda f, kind: F.struct(F.lit(f).alias("field"), F.lit(kind).alias("kind"))
    second = F.when(k % 6 == 1, key("b", "-1")).when(k % 6 == 3, key("b", "hashed")).when(k % 6 == 4, key("a.x", "1")).when(k % 6 == 5, key("zz", "1")).otherwise(key("b", "1"))
    specs = table(spark, d, "part").select(F.concat(F.lit("ix"), k.cast("string")).alias("name"), F.array(key("a", "1"), second).alias("keys"), (k % 2 == 0).alias("is_unique"), (k % 6 == 2).alias("ttl"), F.lit(False).alias("partial"), F.lit(False).alias("sparse"))
    return infer.translate_indexes(specs, spark.createDataFrame([("a", "col_a"), ("b", "col_b"), ("a.x", "col_x")], "field_name string, pg_column string"))


@query("apply_annotations", "SELECT 'f' || CAST(p_partkey AS VARCHAR) AS field_name, CASE WHEN p_partkey % 3 = 0 THEN 'numeric,text,jsonb' ELSE 'text,numeric,jsonb' END AS options, CASE WHEN p_partkey % 3 = 0 THEN 'AI: why' || CAST(p_partkey AS VARCHAR) ELSE '' END AS warnings FROM part")
def _(spark, d):
    keys = _keys(spark, d)
    inferred = keys.select("field_name", F.array(F.lit("text"), F.lit("numeric"), F.lit("jsonb")).alias("options"), F.array().cast("array<string>").alias("warnings"))
    notes = keys.where("p_partkey % 3 = 0").select("field_name", F.lit("numeric").alias("option"), F.concat(F.lit("why"), F.col("p_partkey").cast("string")).alias("reason"))
    out = infer.apply_annotations(inferred, notes.union(spark.createDataFrame([("unknown", "text", "x")], notes.schema)))
    return out.select("field_name", F.array_join("options", ",").alias("options"), F.array_join("warnings", ",").alias("warnings"))
