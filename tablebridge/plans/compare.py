"""Comparing schemas and mapping types between databases; columns are (table_name, column_name, type, nullable, is_pk)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# MySQL type texts to Postgres; exact ones first, then prefixes.
EXACT = {
    "datetime": "timestamp", "tinyint(1)": "boolean", "tinyint": "smallint", "mediumint": "integer", "int": "integer", "double": "double precision", "float": "real",
    "longtext": "text", "mediumtext": "text", "tinytext": "text", "longblob": "bytea", "mediumblob": "bytea", "tinyblob": "bytea", "blob": "bytea", "json": "jsonb", "year": "smallint", "bit(1)": "boolean",
}
PREFIXES = {
    "int(": "integer", "bigint(": "bigint", "smallint(": "smallint", "tinyint(": "smallint", "mediumint(": "integer", "double(": "double precision", "float(": "real",
    "enum(": "text", "set(": "text", "varbinary(": "bytea", "binary(": "bytea",
}


def map_type(text: Column) -> Column:
    """A MySQL type's Postgres text; what no rule names passes unchanged."""
    low = F.lower(F.trim(text))
    out = F.when(low.isin(list(EXACT)), F.element_at(F.create_map(*(F.lit(x) for kv in EXACT.items() for x in kv)), low))
    for prefix, kind in PREFIXES.items():
        out = out.when(low.startswith(prefix), kind)
    return out.otherwise(text)


def to_spark_type(text: str) -> T.DataType:
    """The Spark type that carries a database type."""
    low = text.strip().lower()
    bare = low.split("(")[0].split(" ")[0]
    if low in ("tinyint(1)", "bit(1)") or bare in ("boolean", "bool"):
        return T.BooleanType()
    if bare in ("smallint", "tinyint", "int2", "year", "smallserial"):
        return T.ShortType()
    if bare in ("int", "integer", "int4", "mediumint", "serial"):
        return T.IntegerType()
    if bare in ("bigint", "int8", "bigserial"):
        return T.LongType()
    if bare in ("double", "float8"):
        return T.DoubleType()
    if bare in ("real", "float", "float4"):
        return T.FloatType()
    if bare in ("numeric", "decimal"):
        inside = [int(x) for x in low.partition("(")[2].rstrip(")").split(",") if x.strip().isdigit()]
        return T.DecimalType(*(inside if inside else [38, 10]))
    if bare == "date":
        return T.DateType()
    if bare in ("timestamp", "timestamptz", "datetime"):
        return T.TimestampType()
    if bare in ("bytea", "blob", "longblob", "mediumblob", "tinyblob", "binary", "varbinary"):
        return T.BinaryType()
    return T.StringType()


def compare_schemas(source: DataFrame, target: DataFrame) -> DataFrame:
    """table_name, column_name, kind, severity, suggestion: missing tables and columns are errors, differing type texts warnings; names are case-sensitive, target-only columns ignored."""
    have = target.select(F.col("table_name").alias("_t")).distinct()
    lost = source.select("table_name").distinct().join(have, F.col("table_name") == F.col("_t"), "left_anti").select("table_name", F.lit("").alias("column_name"), F.lit("missing_table").alias("kind"), F.lit("").alias("source_type"), F.lit("").alias("target_type"))
    t = target.select(F.col("table_name").alias("_t"), F.col("column_name").alias("_c"), F.col("type").alias("target_type"))
    both = source.join(have, F.col("table_name") == F.col("_t"), "left_semi").join(t, (F.col("table_name") == F.col("_t")) & (F.col("column_name") == F.col("_c")), "left")
    kind = F.when(F.col("target_type").isNull(), "missing_column").when(F.col("type") != F.col("target_type"), "type_mismatch")
    found = both.select("table_name", "column_name", kind.alias("kind"), F.col("type").alias("source_type"), F.coalesce("target_type", F.lit("")).alias("target_type")).where("kind IS NOT NULL")
    issues = lost.union(found)
    text = (
        F.when(F.col("kind") == "missing_table", F.format_string("create table %s in the target", "table_name"))
        .when(F.col("kind") == "missing_column", F.format_string("add column %s.%s of type %s", "table_name", "column_name", "source_type"))
        .otherwise(F.format_string("check the cast of %s.%s from %s to %s", "table_name", "column_name", "source_type", "target_type"))
    )
    return issues.select("table_name", "column_name", "kind", F.when(F.col("kind") == "type_mismatch", "warning").otherwise("error").alias("severity"), text.alias("suggestion"))


def compatibility(issues: DataFrame, tables: DataFrame) -> DataFrame:
    """table_name, issues, errors, compatible for every table of tables (table_name)."""
    by = issues.groupBy("table_name").agg(F.count("*").alias("issues"), F.count_if(F.col("severity") == "error").alias("errors"))
    zero = F.lit(0).cast("long")
    return tables.join(by, "table_name", "left").select("table_name", F.coalesce("issues", zero).alias("issues"), F.coalesce("errors", zero).alias("errors"), (F.coalesce("errors", zero) == 0).alias("compatible"))


def side_by_side(source: DataFrame, target: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """table_name, column_name, source_type, target_type; either may be null. With a plan (collection, field_name, pg_type, strategy) also planned_type and strategy where it has the column."""
    s = source.select("table_name", "column_name", F.col("type").alias("source_type"))
    t = target.select("table_name", "column_name", F.col("type").alias("target_type"))
    both = s.join(t, ["table_name", "column_name"], "full")
    if plan is None:
        return both
    p = plan.select(F.col("collection").alias("table_name"), F.col("field_name").alias("column_name"), F.nullif("pg_type", F.lit("")).alias("planned_type"), "strategy")
    return both.join(p, ["table_name", "column_name"], "left")


def render_ddl(columns: DataFrame, dialect: str = "postgres", constraints: DataFrame | None = None) -> DataFrame:
    """table_name, ddl: CREATE TABLE text from columns with ordinal and, if there is such a column, default (SQL text); MySQL types are mapped for Postgres, the key is a table clause.

    constraints (table_name, name, kind, columns, ref_table, ref_columns, clause), column lists comma-joined, become clauses
    of the sqlite text, where they cannot be added later; foreign keys first, then checks, by name.
    """
    quote = "`" if dialect == "mysql" else '"'
    kind = map_type(F.col("type")) if dialect == "postgres" else F.col("type")
    default = F.coalesce(F.concat(F.lit(" DEFAULT "), "default"), F.lit("")) if "default" in columns.columns else F.lit("")
    line = F.concat(F.lit(quote), "column_name", F.lit(quote + " "), kind, F.when(~F.col("nullable"), F.lit(" NOT NULL")).otherwise(F.lit("")), default)
    by = columns.groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("lines"),
        F.array_sort(F.collect_list(F.when(F.col("is_pk"), F.struct("ordinal", F.concat(F.lit(quote), "column_name", F.lit(quote)).alias("line"))))).alias("keys"),
    )
    key = F.when(F.size("keys") > 0, F.concat(F.lit(", PRIMARY KEY ("), F.array_join(F.transform("keys", lambda x: x["line"]), ", "), F.lit(")"))).otherwise(F.lit(""))
    more = F.lit("")
    if constraints is not None and dialect == "sqlite":
        named = lambda c: F.concat(F.lit(quote), F.replace(F.col(c), F.lit(","), F.lit(f"{quote}, {quote}")), F.lit(quote))
        foreign = F.concat(F.lit(", FOREIGN KEY ("), named("columns"), F.lit(f") REFERENCES {quote}"), "ref_table", F.lit(f"{quote} ("), named("ref_columns"), F.lit(")"))
        clause = F.when(F.col("kind") == "foreign_key", foreign).when(F.col("kind") == "check", F.concat(F.lit(", CHECK ("), "clause", F.lit(")")))
        own = constraints.withColumn("_clause", clause).where("_clause IS NOT NULL")
        lists = own.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct((F.col("kind") == "check").alias("late"), "name", "_clause"))).alias("more"))
        by = by.join(lists, "table_name", "left")
        more = F.coalesce(F.array_join(F.transform("more", lambda x: x["_clause"]), ""), F.lit(""))
    return by.select("table_name", F.concat(F.lit(f"CREATE TABLE IF NOT EXISTS {quote}"), "table_name", F.lit(f"{quote} ("), F.array_join(F.transform("lines", lambda x: x["line"]), ", "), key, more, F.lit(")")).alias("ddl"))


def assemble_indexes(rows: DataFrame) -> DataFrame:
    """table_name, index_name, is_unique, columns in key order from one row a key column (…, position, column_name); automatic SQLite names become uq_<table>_<columns>."""
    by = rows.where("column_name IS NOT NULL").groupBy("table_name", "index_name", "is_unique").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "column_name"))), lambda x: x["column_name"]).alias("c"))
    name = F.when(F.col("index_name").startswith("sqlite_autoindex_"), F.concat(F.lit("uq_"), "table_name", F.lit("_"), F.array_join("c", "_"))).otherwise(F.col("index_name"))
    return by.select("table_name", name.alias("index_name"), "is_unique", F.array_join("c", ",").alias("columns"))


def assemble_foreign_keys(rows: DataFrame) -> DataFrame:
    """table_name, constraint_name, columns, ref_table, ref_columns, paired by position. A constraint that has a number for a name, as in SQLite, is called fk_<table>_<number>."""
    number = F.concat(F.lit("fk_"), F.replace("table_name", F.lit('"'), F.lit("")), F.lit("_"), F.col("constraint_name").cast("string"))
    rows = rows.withColumn("constraint_name", F.when(F.col("constraint_name").cast("string").rlike("^[0-9]+$"), number).otherwise(F.col("constraint_name").cast("string")))
    by = rows.groupBy("table_name", "constraint_name", "ref_table").agg(F.array_sort(F.collect_list(F.struct("position", "column_name", "ref_column"))).alias("k"))
    return by.select("table_name", "constraint_name", F.array_join(F.transform("k", lambda x: x["column_name"]), ",").alias("columns"), "ref_table", F.array_join(F.transform("k", lambda x: x["ref_column"]), ",").alias("ref_columns"))


def list_checks(rows: DataFrame) -> DataFrame:
    """CHECK rows (…, clause) but those that only say IS NOT NULL."""
    return rows.where(~F.col("clause").endswith("IS NOT NULL"))


def introspect_columns(name: str, df: DataFrame, keys: list[str] = ()) -> list[tuple]:
    """Rows (table_name, column_name, type, nullable, is_pk, ordinal, default) of a DataFrame's schema; the default is the column's, where the catalog keeps one."""
    return [(name, f.name, f.dataType.simpleString(), f.nullable and f.name not in keys, f.name in keys, i, f.metadata.get("CURRENT_DEFAULT")) for i, f in enumerate(df.schema, 1)]
