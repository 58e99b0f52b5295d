"""Merging a source into a target, reloads, and shaping rows for a sink. Every function returns the new target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def last_by_key(df: DataFrame, keys: list[str], order_by: str | None = None) -> DataFrame:
    """One row a key: the one of greatest order_by, or any."""
    if order_by is None:
        return df.dropDuplicates(keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order_by).desc()))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (a[k] == b[k])
    return out


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order_by: str | None = None, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """New keys are inserted, other columns of existing keys overwritten, nothing is deleted.

    Columns that only the target has keep their value; those in keep_first keep a value that is not null. Of source rows
    with equal keys the last by order_by counts.
    """
    s = last_by_key(source, keys, order_by)
    shared = [c for c in target.columns if c in source.columns]
    if len(shared) == len(target.columns) and not keep_first:
        # whole rows are overwritten: only the source's keys meet the target, and a small source needs no shuffle of it
        return target.join(s.select(*keys), keys, "left_anti").select(*target.columns).unionByName(s.select(*target.columns))
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    joined = target.alias("t").join(s.withColumn("_new", F.lit(True)).alias("s"), on, "left")

    def value(c: str) -> Column:
        if c not in shared or c in keys:
            return F.col(f"t.{c}").alias(c)
        if c in keep_first:
            return F.coalesce(f"t.{c}", f"s.{c}").alias(c)
        return F.when(F.col("s._new"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)

    new = s.join(target.select(*keys), keys, "left_anti").select(*shared)
    return joined.select(*map(value, target.columns)).unionByName(new, allowMissingColumns=True)


def replace_rows(target: DataFrame, source: DataFrame, keys: list[str], order_by: str | None = None) -> DataFrame:
    """Whole rows are replaced by key; columns missing in the source become null."""
    s = last_by_key(source, keys, order_by)
    return target.join(s.select(*keys), keys, "left_anti").select(*target.columns).unionByName(s, allowMissingColumns=True)


def insert_new(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new keys are added, existing keys left as they are."""
    return target.unionByName(source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti").select(*source.columns), allowMissingColumns=True)


def append_unkeyed(target: DataFrame, source: DataFrame, unique: list[str] = (), on_clash: str = "skip", order_by: str | None = None) -> DataFrame:
    """Without a key every source row is added; a second run adds them again.

    With the columns of a unique index, a source row whose values are there already is skipped or, with on_clash "update",
    overwrites the row that has them; of clashing source rows the first or the last by order_by counts. Nulls never clash.
    """
    if on_clash not in ("skip", "update"):
        raise ValueError(f"unknown on_clash {on_clash}")
    if not unique:
        return target.unionByName(source, allowMissingColumns=True)
    keyed = F.lit(True)
    for c in unique:
        keyed = keyed & F.col(c).isNotNull()
    free, rows = source.where(~keyed), source.where(keyed)
    if on_clash == "update":
        merged = upsert(target, rows, list(unique), order_by)
    else:
        if order_by is not None:
            rank = F.row_number().over(Window.partitionBy(*unique).orderBy(F.col(order_by)))
            rows = rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
        merged = insert_new(target, rows, list(unique))
    return merged.unionByName(free.select(*[c for c in merged.columns if c in free.columns]), allowMissingColumns=True)


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df in the columns, order and types of a schema; missing ones are null, others dropped."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def truncate_reload(source: DataFrame, target_schema: T.StructType) -> DataFrame:
    """The target's schema with only the source's rows."""
    return align(source, target_schema)


def recreate_reload(source: DataFrame) -> DataFrame:
    """The source's schema and rows; duplicates of a load that ran twice do not arise, the target is made anew."""
    return source


def bulk_append(target: DataFrame, source: DataFrame, require_empty: bool = True) -> DataFrame:
    """The quick load without conflict handling, meant for a target just emptied or made."""
    if require_empty and not target.isEmpty():
        raise ValueError("bulk_append needs an empty target: truncate or recreate it first")
    return target.unionByName(align(source, target.schema))


def coerce_for_sink(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bytes bound for a column that is not binary become text, others are cast; binary columns stay."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(
        *((F.decode(F.col(f.name), "UTF-8") if isinstance(kinds[f.name], T.BinaryType) and not isinstance(f.dataType, T.BinaryType) else F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema)
    )


def bulk_text_field(column: Column, kind: T.DataType) -> Column:
    r"""A field of the bulk text: \N for null, 1 or 0, timestamps without trailing zeros, special characters behind a backslash."""
    if isinstance(kind, T.BooleanType):
        text = F.when(column, "1").otherwise("0")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.regexp_replace(F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "")
        text = F.when(F.date_format(column, "SSSSSS") == "000000", F.date_format(column, "yyyy-MM-dd HH:mm:ss")).otherwise(text)
    else:
        text = column.cast("string")
        for raw in ("\\", "\t", "\n", "\r", "\0"):
            text = F.replace(text, F.lit(raw), F.lit("\\" + raw))
    return F.when(column.isNull(), F.lit("\\N")).otherwise(text)


def bulk_text_line(df: DataFrame) -> DataFrame:
    """line: the columns by name, tab-separated."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(F.concat_ws("\t", *(bulk_text_field(F.col(c), kinds[c]) for c in sorted(df.columns))).alias("line"))


def export_bulk_text(df: DataFrame, path: str) -> None:
    bulk_text_line(df).write.mode("overwrite").option("lineSep", "\n").text(path)


def alter_columns(df: DataFrame, changes: list[dict]) -> DataFrame:
    """One select for changes of kind add (name, type, default, nullable), drop (name) and alter (name, type).

    An added column that is not nullable needs a default, as the rows that are there already must have a value.
    """
    columns = {c: F.col(c) for c in df.columns}
    for x in changes:
        if x["kind"] == "add":
            if not x.get("nullable", True) and x.get("default") is None:
                raise ValueError(f"column {x['name']} is not nullable and has no default")
            columns.setdefault(x["name"], F.lit(x.get("default")).cast(x["type"]))
        elif x["kind"] == "drop":
            columns.pop(x["name"], None)
        elif x["kind"] == "alter":
            columns[x["name"]] = columns[x["name"]].cast(x["type"])
        else:
            raise ValueError(f"unknown change {x['kind']}")
    return df.select(*(v.alias(k) for k, v in columns.items()))
