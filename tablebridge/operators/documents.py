"""Schemaless documents: reading, walking, field frequencies, and turning them into typed columns by a plan.

Documents are VARIANT values parsed from JSON whose tagged objects ({"$oid": …}, {"$numberLong": …}) keep the types that
plain JSON loses. A tagged object is a scalar.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablebridge.sources.shared import importable, stored

# The tags of the JSON form and the types they stand for.
TAGS = {
    "$oid": "ObjectId",
    "$numberInt": "Int32",
    "$numberLong": "Int64",
    "$numberDouble": "Double",
    "$numberDecimal": "Decimal128",
    "$date": "Date",
    "$binary": "Binary",
    "$regularExpression": "Regex",
    "$timestamp": "Timestamp",
    "$minKey": "MinKey",
    "$maxKey": "MaxKey",
    "$code": "JavaScript",
    "$symbol": "Symbol",
    "$undefined": "Undefined",
    "$dbPointer": "DBPointer",
}
#: Digits after the point of a decimal column.
SCALE = 18
# The types whose values are converted; all others are text.
CONVERTED = ("integer", "bigint", "double precision", "numeric", "boolean", "timestamptz", "bytea")
#: The column of apply_plan's check.
_CHECKED = "_checked"
#: Different fields that a task counts before it passes them on.
HELD_FIELDS = 100_000


def read_documents(spark: SparkSession, path: str, id_field: str = "_id") -> DataFrame:
    """doc_id (its JSON text), doc: a file of one document a line; lines that do not parse have a null doc."""
    return parse_documents(spark.read.text(path), "value", id_field)


def parse_documents(df: DataFrame, column: str, id_field: str = "_id") -> DataFrame:
    parsed = df.select(F.try_parse_json(column).alias("doc"))
    return parsed.select(field(F.col("doc"), id_field, "string").alias("doc_id"), "doc").withColumn("doc_id", F.coalesce(tag_text(F.col("doc"), id_field, "$oid"), "doc_id"))


def _step(name: str) -> str:
    return "['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def field(doc: Column, path: str | list[str], kind: str = "variant") -> Column:
    """The value at a path (a list of names; a text is one name), null where absent or of another type."""
    names = [path] if isinstance(path, str) else path
    return F.try_variant_get(doc, "$" + "".join(map(_step, names)), kind)


def tag_text(doc: Column, path: str | list[str], tag: str) -> Column:
    names = [path] if isinstance(path, str) else path
    return F.try_variant_get(doc, "$" + "".join(map(_step, [*names, tag])), "string")


def document_type(v: Column) -> Column:
    """The document type of a VARIANT: a tag's, or String, Boolean, Int64, Double, Array, Document, null."""
    shape = F.schema_of_variant(v)
    keys = F.when(shape.startswith("OBJECT<"), F.regexp_extract(shape, r"^OBJECT<`?(\$[A-Za-z]+)", 1))
    keys = F.when((keys == "$code") & shape.contains("$scope"), "$scope").otherwise(keys)
    tagged = F.element_at(F.create_map(*(F.lit(x) for kv in [*TAGS.items(), ("$scope", "CodeWithScope")] for x in kv)), F.when(keys != "", keys))
    plain = (
        F.when(F.is_variant_null(v), "null")
        .when(shape.startswith("OBJECT<"), "Document")
        .when(shape.startswith("ARRAY<"), "Array")
        .when(shape == "STRING", "String")
        .when(shape == "BOOLEAN", "Boolean")
        .when(shape == "BIGINT", "Int64")
        .otherwise("Double")
    )
    return F.coalesce(tagged, plain)


def is_document(doc: Column) -> Column:
    """Whether a VARIANT is an object: texts that do not parse, arrays and scalars are none."""
    return F.try_variant_get(doc, "$", "map<string,variant>").isNotNull()


def catch_all(taken: set[str], extra: str = "_extra") -> str:
    """The name of the catch-all column beside the columns taken."""
    name, i = extra, 2
    while name in taken:
        name, i = f"{extra}_{i}", i + 1
    return name


def walk_documents(docs: DataFrame) -> DataFrame:
    """doc_id, field_name, type_name for every field of docs (doc_id, doc), at any depth: nested documents are listed and entered, arrays listed only. What is no document has no fields.

    One lateral explode a level. A level is written to the shared folder with the documents that it holds, so that the
    source is read once and each level works on the documents of the one before.
    """
    spark, level, out = docs.sparkSession, docs.where(is_document(F.col("doc"))).select("doc_id", F.lit("").alias("path"), F.col("doc").alias("v")), None
    while True:
        opened = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        name = F.when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key"))
        typed = opened.select("doc_id", name.alias("field_name"), document_type(F.col("value")).alias("type_name"), F.col("value").alias("v"))
        found = stored(typed.withColumn("v", F.when(F.col("type_name") == "Document", F.col("v"))), "level")
        rows = found.select("doc_id", "field_name", "type_name")
        out = rows if out is None else out.union(rows)
        level = found.where("type_name = 'Document'").select("doc_id", F.col("field_name").alias("path"), "v")
        if level.isEmpty():
            return out


def field_frequency(walked: DataFrame, total: Column | int) -> DataFrame:
    """field_name, occurrences (present and not null), null_count, absent_count, total_docs, types (type and count, the most frequent first, then by name), polymorphic, coverage."""
    return _frequency(walked.groupBy("field_name", "type_name").agg(F.count("*").alias("n")), total)


def _frequency(by_type: DataFrame, total: Column | int) -> DataFrame:
    seen = F.filter(F.collect_list(F.struct((-F.col("n")).alias("rank"), F.col("type_name"))), lambda x: x["type_name"] != "null")
    fields = by_type.groupBy("field_name").agg(
        F.coalesce(F.sum(F.when(F.col("type_name") != "null", F.col("n"))), F.lit(0)).alias("occurrences"),
        F.coalesce(F.sum(F.when(F.col("type_name") == "null", F.col("n"))), F.lit(0)).alias("null_count"),
        F.array_sort(seen).alias("ranked"),
    )
    total = F.lit(total).cast("long") if isinstance(total, int) else total
    absent = F.greatest(total - F.col("occurrences") - F.col("null_count"), F.lit(0).cast("long"))
    types = F.transform("ranked", lambda x: F.struct(x["type_name"].alias("type_name"), (-x["rank"]).alias("count")))
    return fields.select("field_name", "occurrences", "null_count", absent.alias("absent_count"), total.alias("total_docs"), types.alias("types"), (F.size("ranked") > 1).alias("polymorphic"), coverage(F.col("occurrences"), total).alias("coverage"))


class _Fields:
    """A trie of field names: a node counts the types its field had and holds the fields inside."""

    __slots__ = ("inside", "types")

    def __init__(self) -> None:
        self.inside: dict[str, _Fields] = {}
        self.types: dict[str, int] = {}

    def add(self, doc: dict) -> int:
        """Count a document's fields; the number of new nodes."""
        new, todo = 0, [(self, doc)]
        while todo:
            node, fields = todo.pop()
            for name, value in fields.items():
                field = node.inside.get(name)
                if field is None:
                    field = node.inside[name] = _Fields()
                    new += 1
                kind = _json_type(value)
                field.types[kind] = field.types.get(kind, 0) + 1
                if kind == "Document":
                    todo.append((field, value))
        return new

    def rows(self) -> Iterator[tuple[str, str, int]]:
        todo = [("", self)]
        while todo:
            path, node = todo.pop()
            for name, field in node.inside.items():
                full = f"{path}.{name}" if path else name
                yield from ((full, kind, n) for kind, n in field.types.items())
                todo.append((full, field))


def _json_type(v: object) -> str:
    """The document type of a parsed JSON value, as document_type() has it."""
    if isinstance(v, dict):
        first = min(v, default="")
        return "CodeWithScope" if first == "$code" and "$scope" in v else TAGS.get(first, "Document")
    if isinstance(v, bool):
        return "Boolean"
    if isinstance(v, int):
        return "Int64" if -(2**63) <= v < 2**63 else "Double"
    return "null" if v is None else "String" if isinstance(v, str) else "Array" if isinstance(v, list) else "Double"


def _unique(pairs: list[tuple[str, object]]) -> dict:
    if len(out := dict(pairs)) < len(pairs):
        raise ValueError("a name occurs twice")
    return out


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def count_fields(lines: DataFrame, column: str) -> DataFrame:
    """field_name, type_name, n of all documents in a column of JSON texts; in rows without field_name the type is `document` or `rejected`, for texts that are a document or none.

    One pass: each task counts into a trie of field names, of HELD_FIELDS names at most, and only its counts by path are
    shuffled. The fields are those of walk_documents().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, size, told = _Fields(), 0, {"document": 0, "rejected": 0}

        def out() -> pa.RecordBatch:
            rows = [*trie.rows(), *((None, kind, n) for kind, n in told.items())]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["field_name", "type_name", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                try:
                    doc = json.loads(text, object_pairs_hook=_unique, parse_constant=_refuse) if text else None
                except (ValueError, RecursionError):
                    doc = None
                if isinstance(doc, dict):
                    told["document"] += 1
                    size += trie.add(doc)
                else:
                    told["rejected"] += 1
            if size > HELD_FIELDS:
                yield out()
                trie, size, told = _Fields(), 0, {"document": 0, "rejected": 0}
        yield out()

    importable(lines.sparkSession)
    counts = lines.select(F.col(column).cast("string").alias("text")).mapInArrow(run, "field_name string, type_name string, n long")
    return counts.groupBy("field_name", "type_name").agg(F.sum("n").alias("n")).where("n > 0")


def text_frequency(lines: DataFrame, column: str) -> DataFrame:
    """field_frequency() of a column of JSON texts in one scan and one shuffle of paths; texts that are no document count nowhere."""
    counts = stored(count_fields(lines, column), "fields")
    total = counts.where("field_name IS NULL AND type_name = 'document'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return _frequency(counts.where("field_name IS NOT NULL"), total)


def coverage(occurrences: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(occurrences / total * 100)


def _rfc3339(millis: Column) -> Column:
    """A point of time in UTC, with as many digits of the second as it needs."""
    utc = F.to_utc_timestamp(F.timestamp_millis(millis), F.current_timezone())
    part = F.regexp_replace(F.date_format(utc, ".SSS"), r"\.?0+$", "")
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit("Z"))


def canonical_json(v: Column) -> Column:
    """JSON text with sorted keys and the tags resolved at any depth: object ids, decimals and symbols as text, dates by RFC 3339 in UTC, numbers bare, binary in base64.

    In JSON text a tag inside a string has escaped quotes, so the patterns match only tagged objects.
    """
    return _resolved(F.to_json(v))


def _resolved(text: Column) -> Column:
    """JSON text without its tags."""
    date = r'\{"\$date":(?:\{"\$numberLong":"(-?[0-9]+)"\}|(-?[0-9]+))\}'
    millis = F.transform(F.regexp_extract_all(text, F.lit(date), 0), lambda m: F.regexp_extract(m, r"(-?[0-9]+)[^0-9]*$", 1).try_cast("bigint"))
    pieces = F.transform(F.split(text, date), lambda p, i: F.concat(p, F.coalesce(F.concat(F.lit('"'), _rfc3339(F.get(millis, i)), F.lit('"')), F.lit(""))))
    found = F.when(text.contains('{"$date":'), F.array_join(pieces, "")).otherwise(text)
    found = F.regexp_replace(found, r'\{"\$(?:numberInt|numberLong|numberDouble)":"([^"\\]*)"\}', "$1")
    found = F.regexp_replace(found, r'\{"\$(?:oid|numberDecimal|date|symbol|code)":("(?:[^"\\]|\\.)*")\}', "$1")
    found = F.regexp_replace(found, r'\{"\$binary":\{"base64":("[^"\\]*"),"subType":"[^"\\]*"\}\}', "$1")
    found = F.regexp_replace(found, r'\{"\$regularExpression":\{"options":"[^"\\]*","pattern":("(?:[^"\\]|\\.)*")\}\}', "$1")
    return F.when(text.contains('{"$'), found).otherwise(text)


def _decimal(text: Column) -> Column:
    """The exact decimal; null where it needs more than SCALE digits after the point or does not fit."""
    shape = r"^[-+]?[0-9]*(?:\.([0-9]*?)0*)?(?:[eE]([-+]?[0-9]+))?$"
    digits = F.length(F.regexp_extract(text, shape, 1)) - F.coalesce(F.nullif(F.regexp_extract(text, shape, 2), F.lit("")).try_cast("int"), F.lit(0))  # a cast that fails is slow
    return F.when(text.rlike(shape) & (digits <= SCALE), text.try_cast(f"decimal(38,{SCALE})"))


def _converted(plain: Column, inside: Column, pg_type: str) -> Column:
    """The typed value of a field, from its plain text and, of an object, its map; null where it does not convert."""
    tag, value = F.get(F.map_keys(inside), F.lit(0)), F.get(F.map_values(inside), F.lit(0))
    alone = F.when(inside.isNull(), plain)
    number = F.when(tag.isin("$numberInt", "$numberLong", "$numberDouble", "$numberDecimal"), value).otherwise(alone)
    if pg_type == "integer":
        return number.try_cast("int").cast("bigint")
    if pg_type == "bigint":
        return number.try_cast("bigint")
    if pg_type == "double precision":
        return number.try_cast("double")
    if pg_type == "numeric":
        return _decimal(number)
    if pg_type == "boolean":
        return alone.try_cast("boolean")
    if pg_type == "timestamptz":
        millis = F.coalesce(F.regexp_extract(value, r'^\{"\$numberLong":"(-?[0-9]+)"\}$', 1).try_cast("bigint"), value.try_cast("bigint"))
        return F.when(tag == "$date", F.coalesce(F.timestamp_millis(millis), value.try_cast("timestamp"))).otherwise(alone.try_cast("timestamp"))
    if pg_type == "bytea":
        return F.when(tag == "$binary", F.unbase64(F.get_json_object(value, "$.base64")))
    # text: documents, arrays and the rare types stay JSON text
    return _text(inside).when(inside.isNotNull() | plain.startswith("["), _resolved(plain)).otherwise(plain)


def _text(inside: Column) -> Column:
    """The text that a tagged object stands for, where it is one that stands for text; to be continued."""
    tag, value = F.get(F.map_keys(inside), F.lit(0)), F.get(F.map_values(inside), F.lit(0))
    text = F.when(tag.isin("$oid", "$numberInt", "$numberLong", "$numberDouble", "$numberDecimal", "$symbol"), value)
    return text.when(tag == "$regularExpression", F.get_json_object(value, "$.pattern"))


def _shape(paths: list[tuple[list[str], str]]) -> str:
    """The struct type that holds these paths (of one or two names) with their types."""
    quoted = lambda name: "`" + name.replace("`", "``") + "`"
    tops: dict[str, list[str] | str] = {}
    for parts, kind in paths:
        if len(parts) == 1:
            tops[parts[0]] = kind
        else:
            tops.setdefault(parts[0], []).append(f"{quoted(parts[1])}: {kind}")
    return "struct<" + ", ".join(f"{quoted(k)}: {v if isinstance(v, str) else 'struct<' + ', '.join(v) + '>'}" for k, v in tops.items()) + ">"


def _conversion(docs: DataFrame, plan: list[dict]) -> tuple[DataFrame, list[tuple[dict, Column]], Column]:
    """docs with what the plan needs, the plan's rows with their values, and which documents are bad.

    A document is opened twice: once into the plain texts of its planned scalars and the values for JSON columns, once into
    the maps of those that are objects. It is bad if it did not parse, is no object, or if a direct value, planned itself or as
    the child of a flattened parent, is there and does not convert.
    """
    flat = {r["field_name"] for r in plan if r["strategy"] == "flatten"}
    live = [(r, r["field_name"].split("."), "jsonb" if r["strategy"] == "as_jsonb" else r["pg_type"]) for r in plan if r["strategy"] in ("direct", "as_jsonb")]
    filled = lambda parts: len(parts) == 1 or (len(parts) == 2 and parts[0] in flat)
    wanted = [(parts, kind) for _, parts, kind in live if filled(parts)]
    scalars = [(parts, "map<string, string>") for parts, kind in wanted if kind != "jsonb"]

    def opened(shape: list[tuple[list[str], str]]) -> Column:
        return F.try_variant_get("doc", "$", _shape(shape)) if shape else F.lit(None)

    docs = docs.withColumns({"_plain": opened([(parts, "variant" if kind == "jsonb" else "string") for parts, kind in wanted]), "_inside": opened(scalars)})
    # the struct of what is wanted is there for every object, and for nothing else
    values, bad, texts = [], F.col("_plain").isNull() if wanted else ~is_document(F.col("doc")), {}
    for i, (r, parts, kind) in enumerate(live):
        at = lambda name: reduce(lambda c, part: c.getField(part), parts, F.col(name))  # noqa: B023, E731
        if not filled(parts):
            value = F.lit(None).cast("string")  # only a flattened parent fills its children, one level deep
        elif kind == "jsonb":
            texts[f"_json_{i}"] = F.when(~F.is_variant_null(at("_plain")), F.to_json(at("_plain")))
            value = _resolved(F.col(f"_json_{i}"))
        else:
            value = _converted(at("_plain"), at("_inside"), kind)
            # of a text only what a tag stands for may be missing, the rest need not be made to know
            found = _text(at("_inside")).otherwise(at("_plain")) if kind not in CONVERTED else value
            bad = bad | (at("_plain").isNotNull() & found.isNull())
        values.append((r, value))
    return docs.withColumns(texts) if texts else docs, values, F.coalesce(bad, F.lit(False))


def apply_plan(docs: DataFrame, plan: list[dict], on_error: str = "abort", extra: str = "_extra") -> DataFrame:
    """Documents (doc_id, doc) as columns: one select made from the plan's rows (field_name, pg_column, pg_type, strategy).

    direct gives a typed column, as_jsonb JSON text, flatten the planned children of a document (one level; its other children and
    values that are no document go to `extra`), skip nothing. Top-level fields without a plan row go to `extra`, null where there
    are none; where the plan has a column of that name it is called `_extra_2` and so on. A direct value that does not convert stops
    the job (abort), drops the document (skip) or is null (null); so does a text that is no document. A decimal that needs more than 18 digits after the point does not convert, nor an integer beyond 32 bits.
    """
    top = {r["field_name"] for r in plan if "." not in r["field_name"]}
    flat = {r["field_name"] for r in plan if r["strategy"] == "flatten"}
    docs, values, bad = _conversion(docs, plan)
    doc = F.col("doc")
    # what is used more than once is a column of its own, so that it is made once
    docs = docs.withColumn("_fields", F.coalesce(F.try_variant_get(doc, "$", "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>")))
    fields = F.col("_fields")
    docs = docs.withColumn("_left", F.array_except(F.map_keys(fields), F.array(*map(F.lit, sorted(top))).cast("array<string>")))
    rest = F.map_from_arrays("_left", F.transform("_left", lambda k: fields[k]))
    for name in sorted(flat):
        rest = F.map_concat(rest, _unplanned_children(doc, fields, name, [r["field_name"].split(".", 1)[1] for r in plan if r["field_name"].startswith(name + ".")]))
    docs = docs.withColumn("_rest", rest).withColumn("_rest_json", F.when(F.size("_rest") > 0, F.to_json(F.to_variant_object("_rest"))))
    columns = [*(value.alias(r["pg_column"]) for r, value in values), _resolved(F.col("_rest_json")).alias(catch_all({r["pg_column"] for r, _ in values}, extra))]
    if on_error == "null":
        return docs.select(*columns)
    good = ~bad if on_error == "skip" else F.assert_true(~bad, F.lit("a value does not convert to its planned type")).isNull()
    return _passed(docs.select(*columns, good.alias(_CHECKED)))


def _passed(checked: DataFrame) -> DataFrame:
    """The rows whose check is true, without it. They pass by an explode, not a filter: the check is made once, where the row is, and columns that nobody asks for are pruned, but not the check."""
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in checked.columns if c != _CHECKED]
    # an expression, not a column, so that no filter is inferred and pushed down to be made anew there
    return checked.select(*kept, F.explode(F.when(F.col(_CHECKED), F.array(F.lit(True)))).alias("_passed")).select(*kept)


def _unplanned_children(doc: Column, fields: Column, name: str, known: list[str]) -> Column:
    """A flattened field's children outside the plan under their dotted names, or its value where that is no document; an empty map otherwise."""
    inner = F.try_variant_get(doc, "$" + _step(name), "map<string,variant>")
    more = F.map_filter(inner, lambda k, v: ~F.array_contains(F.array(*map(F.lit, known)).cast("array<string>"), k))
    more = F.transform_keys(more, lambda k, v: F.concat(F.lit(name + "."), k))
    alone = field(doc, name)
    other = F.when(inner.isNull() & alone.isNotNull() & ~F.is_variant_null(alone), F.create_map(F.lit(name), alone))
    return F.coalesce(more, other, F.map_filter(fields, lambda k, v: F.lit(False)))


def rejected_documents(docs: DataFrame, plan: list[dict]) -> DataFrame:
    """The documents that apply_plan drops under skip."""
    checked, _, bad = _conversion(docs, plan)
    return _passed(checked.select(*docs.columns, bad.alias(_CHECKED)))
