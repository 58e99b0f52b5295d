"""The plan store: merging inferred and user rows, overrides, views and frozen copies. A plan row is (project_id, collection, field_name, pg_column, pg_type, strategy, is_pk, nullable, overridden)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["project_id", "collection", "field_name"]
VALUES = ["pg_column", "pg_type", "strategy", "is_pk", "nullable"]
STRATEGIES = ["direct", "as_jsonb", "flatten", "skip"]


def merge_plan(current: DataFrame, inferred: DataFrame) -> DataFrame:
    """Inferred rows refresh the plan; overridden rows stay as they are; new rows are added."""
    c, i = current.alias("c"), inferred.withColumn("_new", F.lit(True)).alias("i")
    joined = c.join(i, [F.col(f"c.{k}") == F.col(f"i.{k}") for k in KEYS], "full")
    stays = F.coalesce(F.col("c.overridden"), F.lit(False)) | F.col("i._new").isNull()
    return joined.select(*(F.coalesce(f"c.{k}", f"i.{k}").alias(k) for k in KEYS), *(F.when(stays, F.col(f"c.{v}")).otherwise(F.col(f"i.{v}")).alias(v) for v in VALUES), F.coalesce("c.overridden", F.lit(False)).alias("overridden"))


def override_plan(current: DataFrame, overrides: DataFrame) -> DataFrame:
    """User rows win and are marked; fields that they leave null keep the plan's value. Invalid rows change nothing."""
    good = valid_overrides(overrides).withColumn("_new", F.lit(True)).alias("o")
    joined = current.alias("c").join(good, [F.col(f"c.{k}") == F.col(f"o.{k}") for k in KEYS], "full")
    value = lambda v: F.coalesce(f"o.{v}", f"c.{v}").alias(v)
    return joined.select(*(F.coalesce(f"c.{k}", f"o.{k}").alias(k) for k in KEYS), *map(value, VALUES), (F.coalesce("o._new", F.lit(False)) | F.coalesce("c.overridden", F.lit(False))).alias("overridden"))


def valid_overrides(overrides: DataFrame) -> DataFrame:
    named = (F.coalesce("collection", F.lit("")) != "") & (F.coalesce("field_name", F.lit("")) != "")
    return overrides.where(named & (F.col("strategy").isNull() | F.col("strategy").isin(STRATEGIES)))


def rejected_overrides(overrides: DataFrame) -> DataFrame:
    named = (F.coalesce("collection", F.lit("")) != "") & (F.coalesce("field_name", F.lit("")) != "")
    return overrides.where(~(named & (F.col("strategy").isNull() | F.col("strategy").isin(STRATEGIES))))


def parse_overrides(specs: DataFrame) -> DataFrame:
    """collection, field_name, pg_type, strategy of texts (spec) `collection.field=value`; a value that is no strategy is a type for direct."""
    pattern = r"^([^.=]+)\.([^=]+)=(.*)$"
    part = lambda i: F.regexp_extract("spec", pattern, i)
    known = part(3).isin(STRATEGIES)
    return specs.where(F.col("spec").rlike(pattern)).select(part(1).alias("collection"), part(2).alias("field_name"), F.when(~known, part(3)).alias("pg_type"), F.when(known, part(3)).otherwise("direct").alias("strategy"))


def reset_plan(current: DataFrame, project_id: str, collection: str | None = None) -> DataFrame:
    gone = F.col("project_id") == project_id
    return current.where(~(gone if collection is None else gone & (F.col("collection") == collection)))


def plan_for(plan: DataFrame, project_id: str, collection: str) -> DataFrame:
    return plan.where((F.col("project_id") == project_id) & (F.col("collection") == collection)).orderBy("field_name")


def plan_collections(plan: DataFrame) -> DataFrame:
    return plan.select("project_id", "collection").distinct()


def freeze_plan(plan: DataFrame) -> DataFrame:
    """project_id, collection, schema_plan: a collection's plan rows as one JSON text, so that later overrides do not change a run."""
    row = F.struct("collection", "field_name", *VALUES, "overridden")
    return plan.groupBy("project_id", "collection").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("schema_plan"))


def frozen_plan(frozen: DataFrame) -> DataFrame:
    kind = "array<struct<collection:string,field_name:string,pg_column:string,pg_type:string,strategy:string,is_pk:boolean,nullable:boolean,overridden:boolean>>"
    return frozen.select("project_id", F.explode(F.from_json("schema_plan", kind)).alias("r")).select("project_id", "r.*")


def override_columns(columns: DataFrame, plan: DataFrame) -> DataFrame:
    """columns (table_name, column_name, type, nullable, is_pk) with the plan's type, nullability and key; names stay."""
    p = plan.select(F.col("collection").alias("_t"), F.col("field_name").alias("_f"), F.col("pg_type").alias("_type"), F.col("nullable").alias("_nullable"), F.col("is_pk").alias("_pk"))
    joined = columns.join(p, (F.col("table_name") == F.col("_t")) & (F.col("column_name") == F.col("_f")), "left")
    return joined.select("table_name", "column_name", F.coalesce(F.nullif(F.col("_type"), F.lit("")), "type").alias("type"), F.coalesce("_nullable", "nullable").alias("nullable"), F.coalesce("_pk", "is_pk").alias("is_pk"))
