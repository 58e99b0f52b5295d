"""Checks after a load: keys, references, expressions, counts and rows. Each returns the violations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_primary_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur more than once or hold a null, with n_rows."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where((F.col("n_rows") > 1) | null)


def check_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values that occur more than once; a null never conflicts."""
    return df.dropna(subset=columns).groupBy(*columns).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def check_foreign_key(child: DataFrame, columns: list[str], parent: DataFrame, references: list[str]) -> DataFrame:
    """Child rows whose key, without nulls, no parent has."""
    refs = parent.select(*(F.col(r).alias(f"_r{i}") for i, r in enumerate(references)))
    return child.dropna(subset=columns).join(refs, [F.col(c) == F.col(f"_r{i}") for i, c in enumerate(columns)], "left_anti")


def check_expression(df: DataFrame, sql: str) -> DataFrame:
    """Rows for which the check is false; null passes."""
    return df.where(~F.coalesce(F.expr(sql), F.lit(True)))


def check_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, violations, in one pass."""
    counted = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counted.unpivot([], columns, "column_name", "violations")


def check_constraints(tables: dict[str, DataFrame], constraints: list[dict], done: DataFrame | None = None) -> DataFrame:
    """table_name, name, kind, violations of every constraint; those in done (table_name, name) are not computed.

    A constraint has table, name, kind (primary_key, unique, foreign_key, check, not_null) and columns, references (table, columns) or sql.
    """
    if done is not None:
        names = {(c["table"], c["name"]) for c in constraints}
        # at most every table with every name of the list
        known = done.where(F.col("name").isin([n for _, n in names]) & F.col("table_name").isin([t for t, _ in names])).select("table_name", "name").distinct()
        finished = {tuple(r) for r in known.collect()}
        constraints = [c for c in constraints if (c["table"], c["name"]) not in finished]
    out = None
    for c in constraints:
        df = tables[c["table"]]
        if c["kind"] == "primary_key":
            found = check_primary_key(df, c["columns"]).agg(F.count("*").alias("violations"))
        elif c["kind"] == "unique":
            found = check_unique(df, c["columns"]).agg(F.count("*").alias("violations"))
        elif c["kind"] == "foreign_key":
            found = check_foreign_key(df, c["columns"], tables[c["references"][0]], c["references"][1]).agg(F.count("*").alias("violations"))
        elif c["kind"] == "check":
            found = check_expression(df, c["sql"]).agg(F.count("*").alias("violations"))
        else:
            found = check_not_null(df, c["columns"]).agg(F.sum("violations").alias("violations"))
        one = found.select(F.lit(c["table"]).alias("table_name"), F.lit(c["name"]).alias("name"), F.lit(c["kind"]).alias("kind"), "violations")
        out = one if out is None else out.union(one)
    if out is None:
        return next(iter(tables.values())).sparkSession.createDataFrame([], "table_name string, name string, kind string, violations long")
    return out


def reconcile_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """table_name, source_rows, target_rows, mismatch of two counts (table_name, rows)."""
    both = source.select("table_name", F.col("rows").alias("source_rows")).join(target.select("table_name", F.col("rows").alias("target_rows")), "table_name", "full")
    return both.withColumn("mismatch", ~F.col("source_rows").eqNullSafe(F.col("target_rows")))


def diff_rows(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, status (missing, extra, changed), changed_columns: where the target's rows differ from the source's. A null key meets a null key."""
    s, t = source.withColumn("_s", F.lit(True)).alias("s"), target.withColumn("_t", F.lit(True)).alias("t")
    joined = s.join(t, [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys], "full")
    changed: Column = F.array_compact(F.array(*(F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")), F.lit(c)) for c in columns)))
    status = F.when(F.col("t._t").isNull(), "missing").when(F.col("s._s").isNull(), "extra").when(F.size(changed) > 0, "changed")
    rows = joined.select(*(F.coalesce(f"s.{k}", f"t.{k}").alias(k) for k in keys), status.alias("status"), F.when(status == "changed", F.array_join(changed, ",")).otherwise("").alias("changed_columns"))
    return rows.where("status IS NOT NULL")
