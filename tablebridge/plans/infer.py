"""Relational plans inferred from field frequencies: types, strategies, column names, indexes, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablebridge.operators.documents import catch_all
from tablebridge.sources.shared import stored

# Document type to column type.
SINGLE = {
    "String": "text",
    "Int32": "integer",
    "Int64": "bigint",
    "Double": "double precision",
    "Decimal128": "numeric",
    "Boolean": "boolean",
    "Date": "timestamptz",
    "ObjectId": "text",
    "Binary": "bytea",
    "Array": "jsonb",
    "Document": "jsonb",
    "Regex": "text",
}
# Type of the key by its most frequent document type; others are text with a warning.
KEY_TYPES = {"ObjectId": "text", "String": "text", "Binary": "text", "Int32": "integer", "Int64": "bigint", "Document": "jsonb"}
# Choices offered for a field by its only type, the recommended one first; a type alone is direct, a strategy alone has no type.
CHOICES = {
    "String": ["text", "jsonb"],
    "Int32": ["integer", "bigint", "text"],
    "Int64": ["bigint", "text"],
    "Double": ["double precision", "numeric", "text"],
    "Decimal128": ["numeric", "double precision", "text"],
    "Boolean": ["boolean", "text"],
    "Date": ["timestamptz", "text"],
    "ObjectId": ["text"],
    "Binary": ["bytea", "text"],
    "Array": ["jsonb", "skip"],
    "Document": ["jsonb", "flatten", "skip"],
    "Regex": ["text", "skip"],
}
# Choices for the key by its most frequent type, and for a field of several types by the type that they widen to.
KEY_CHOICES = {"Int32": ["integer", "bigint"], "Int64": ["bigint", "integer"], "Binary": ["text", "uuid"], "Document": ["jsonb"]}
WIDE_CHOICES = {"bigint": ["bigint", "jsonb"], "double precision": ["double precision", "numeric", "jsonb"], "text": ["text", "jsonb"]}
NUMBERS = ["Int32", "Int64", "Double", "Decimal128"]
LONGEST = 63


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def infer_types(freq: DataFrame) -> DataFrame:
    """freq (field_name, types, null_count, absent_count, …) with pg_type, strategy, is_pk, nullable, warnings, options.

    options are the choices for the field, the recommended one first: a type that is stored directly (jsonb as JSON text), or flatten or skip.
    """
    names = F.transform("types", lambda t: t["type_name"])
    within = lambda *xs: F.size(F.array_except(names, F.array(*map(F.lit, xs)))) == 0
    has = lambda *xs: F.arrays_overlap(names, F.array(*map(F.lit, xs)))
    nested, first, key = has("Document", "Array"), F.get(names, F.lit(0)), F.col("field_name") == "_id"
    wide = (
        F.when(within("Int32", "Int64"), "bigint")
        .when(within("Double", "Decimal128"), "numeric")
        .when(within("Int32", "Int64", "Double"), "double precision")
        .when(within(*NUMBERS), "numeric")
        .when(has(*NUMBERS) & has("String") & ~nested, "text")
        .otherwise("jsonb")
    )
    single = F.when(F.size(names) == 0, "text").otherwise(F.coalesce(F.element_at(_map(SINGLE), first), F.lit("jsonb")))
    pg = F.when(key, F.coalesce(F.element_at(_map(KEY_TYPES), first), F.lit("text"))).when(F.size(names) > 1, wide).otherwise(single)
    parts = F.transform("types", lambda t: F.concat(t["type_name"], F.lit("("), t["count"].cast("string"), F.lit(")")))
    warning = (
        F.when(key & (first == "Document"), "document keys are not supported")
        .when(key, F.when(first.isNotNull() & F.element_at(_map(KEY_TYPES), first).isNull(), "unusual key type"))
        .when(F.size(names) > 1, F.concat(F.lit("polymorphic field: "), F.array_join(parts, ", ")))
        .when(first == "Regex", "regex flags are dropped")
        .when(first.isNotNull() & F.element_at(_map(SINGLE), first).isNull(), F.concat(F.lit("unmapped type: "), first))
    )
    lists = lambda d: F.create_map(*(x for k, v in d.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    decimals = F.when(within("Double", "Decimal128"), F.array(*map(F.lit, ("numeric", "double precision", "jsonb")))).otherwise(F.array(F.lit("numeric"), F.lit("jsonb")))
    contained = F.when(nested, F.array(F.lit("jsonb"), F.lit("skip"))).otherwise(F.array(*map(F.lit, ("jsonb", "text", "skip"))))
    widened = F.when(wide == "numeric", decimals).when(wide == "jsonb", contained).otherwise(F.element_at(lists(WIDE_CHOICES), wide))
    alone = F.coalesce(F.element_at(lists(CHOICES), first), F.array(F.lit("jsonb"), F.lit("skip")))
    none = F.size(names) == 0
    options = F.when(key, F.coalesce(F.element_at(lists(KEY_CHOICES), first), F.array(F.lit("text")))).when(none, F.array(F.lit("text"))).when(F.size(names) > 1, widened).otherwise(alone)
    strategy = F.when(key, "direct").when(pg == "jsonb", "as_jsonb").otherwise("direct")
    nullable = ~key & ((F.col("null_count") > 0) | (F.col("absent_count") > 0) | F.col("field_name").contains("."))
    return freq.withColumns({"pg_type": pg, "strategy": strategy, "is_pk": key, "nullable": nullable, "warnings": F.array_compact(F.array(warning)), "options": options})


def _cut(name: Column, most: Column) -> Column:
    """The longest beginning of the name that has at most so many bytes and ends with a whole code point."""
    ends = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(name), F.lit(LONGEST))))
    whole = F.aggregate(ends, F.lit(""), lambda acc, i: F.when(F.octet_length(F.substring(name, F.lit(1), i)) <= most, F.substring(name, F.lit(1), i)).otherwise(acc))
    return F.when(F.octet_length(name) <= most, name).otherwise(whole)


def base_name(field: Column) -> Column:
    """Dots and invalid characters to underscores, an underscore before a leading digit, at most 63 bytes."""
    name = F.regexp_replace(field, r"[^\p{L}\p{Nd}_]", "_")
    name = F.when(name == "", "_field").when(name.rlike(r"^\p{Nd}"), F.concat(F.lit("_"), name)).otherwise(name)
    return _cut(name, F.lit(LONGEST))


def column_names(plan: DataFrame, group: list[str] = ()) -> DataFrame:
    """plan (field_name, …) with pg_column, unique in each group: later fields (`_id` first, then by name) get _2, _3 and so on.

    A base is cut to 60 bytes, or further where its suffix needs the room, so that no name exceeds 63. Suffixed names can
    collide again; then the later ones count on. Every round settles at least one more name, and rounds end when none collides.
    """
    first = F.when(F.col("field_name") == "_id", 0).otherwise(1)
    rows = stored(plan.withColumn("_base", base_name(F.col("field_name"))).withColumn("pg_column", F.col("_base")).withColumn("_try", F.lit(1)), "names")
    while True:
        rank = F.row_number().over(Window.partitionBy(*group, "pg_column").orderBy(F.col("_try"), first, "field_name"))
        numbered = rows.withColumn("_rank", rank)
        if numbered.where("_rank > 1").isEmpty():
            return rows.drop("_base", "_try")
        taken = F.when(F.col("_rank") > 1, F.greatest(F.col("_rank"), F.col("_try") + 1)).otherwise(F.col("_try"))
        counted = numbered.withColumn("_try", taken)
        suffix = F.concat(F.lit("_"), F.col("_try").cast("string"))
        suffixed = F.concat(_cut(F.col("_base"), F.least(F.lit(LONGEST - 3), LONGEST - F.length(suffix))), suffix)
        rows = stored(counted.withColumn("pg_column", F.when(F.col("_try") > 1, suffixed).otherwise(F.col("_base"))).drop("_rank"), "names")


def infer_schema(freq: DataFrame) -> DataFrame:
    """field_name, pg_column, pg_type, strategy, is_pk, nullable, options of each field."""
    return column_names(infer_types(freq)).select("field_name", "pg_column", "pg_type", "strategy", "is_pk", "nullable", "options")


def plan_columns(plan: DataFrame, extra: str = "_extra") -> DataFrame:
    """column_name, type, nullable, is_pk of the target: the direct and as_jsonb fields, and the catch-all, renamed where its name is taken."""
    own = plan.where(F.col("strategy").isin("direct", "as_jsonb")).select(F.col("pg_column").alias("column_name"), F.col("pg_type").alias("type"), "nullable", "is_pk")
    name = catch_all({r[0] for r in own.where(F.col("column_name").startswith(extra)).select("column_name").collect()}, extra)
    rest = plan.sparkSession.createDataFrame([(name, "jsonb", True, False)], own.schema)
    return own.union(rest)


def translate_indexes(specs: DataFrame, plan: DataFrame) -> DataFrame:
    """name, columns, is_unique, skipped, warning of index specs (name, keys array of (field, kind), is_unique, ttl, partial, sparse).

    The first rule that fails skips an index: `_id_` silently, then TTL, partial, sparse, special kinds, dotted and unplanned fields.
    """
    known = plan.select(F.col("field_name").alias("_f"), "pg_column")
    keys = specs.select("*", F.posexplode("keys").alias("pos", "k")).join(known, F.col("k.field") == F.col("_f"), "left")
    by = keys.groupBy("name").agg(
        F.first("is_unique").alias("is_unique"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "pg_column"))), lambda x: x["pg_column"]), ",").alias("columns"),
        F.max(F.col("ttl")).alias("ttl"),
        F.max(F.col("partial")).alias("partial"),
        F.max(F.col("sparse")).alias("sparse"),
        F.max(F.when(~F.col("k.kind").isin("1", "-1"), F.col("k.kind"))).alias("special"),
        F.max(F.when(F.col("k.field").contains("."), F.col("k.field"))).alias("dotted"),
        F.max(F.when(F.col("pg_column").isNull(), F.col("k.field"))).alias("unplanned"),
        F.bool_or(F.col("k.kind") == "-1").alias("down"),
    )
    own = F.col("name") == "_id_"
    reason = (
        F.when(own, "")
        .when(F.col("ttl"), "TTL index")
        .when(F.col("partial"), "partial index")
        .when(F.col("sparse"), "sparse index")
        .when(F.col("special").isNotNull(), F.concat(F.col("special"), F.lit(" index")))
        .when(F.col("dotted").isNotNull(), F.concat(F.lit("nested field "), F.col("dotted")))
        .when(F.col("unplanned").isNotNull(), F.concat(F.lit("field not in plan "), F.col("unplanned")))
    )
    warning = F.when(reason.isNotNull(), reason).when(F.col("down"), "descending order is not kept").otherwise("")
    return by.select("name", F.when(reason.isNull(), F.col("columns")).alias("columns"), "is_unique", reason.isNotNull().alias("skipped"), warning.alias("warning"))


def apply_annotations(inferred: DataFrame, annotations: DataFrame) -> DataFrame:
    """Recommended options move to the front, reasons join the warnings; unknown fields are ignored. inferred has field_name, options, warnings; annotations field_name, option, reason."""
    a = annotations.select(F.col("field_name").alias("_f"), "option", "reason")
    joined = inferred.join(a, F.col("field_name") == F.col("_f"), "left")
    moved = F.when(F.col("option").isNotNull(), F.concat(F.array("option"), F.filter("options", lambda o: o != F.col("option")))).otherwise(F.col("options"))
    told = F.when(F.col("reason").isNotNull(), F.concat("warnings", F.array(F.concat(F.lit("AI: "), "reason")))).otherwise(F.col("warnings"))
    return joined.withColumns({"options": moved, "warnings": told}).drop("_f", "option", "reason")
