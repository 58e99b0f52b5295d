"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Items become windows of consecutive words. An occurrence of a window holds all its words, so the necessary prefix of the
window under a rarity order is its rarest word alone: documents are joined on that word, the position that it implies must
leave room for the window, and the words there are compared with the window's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablebridge.llm.common import stored

WINDOW = 13
#: Windows that may be broadcast at once (some 150 bytes each); more are joined in blocks of so many.
BLOCK = 400_000
# A word is a run of code points outside the first class; with A-Z not lower-cased, outside the second.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _pieces(text: Column, gap: str) -> Column:
    """What lies between gaps. Splitting is several times faster than extracting matches; only the ends can be empty."""
    return F.coalesce(F.array_remove(F.split(text, gap), ""), F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased; none for null. Text in ASCII takes the quick way to the same result."""
    return _pieces(F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER)), GAP)


def n_words(text: Column) -> Column:
    """How many words() gives; lower-casing A-Z moves no word's ends, so none is done."""
    return F.size(_pieces(text, GAP_ANY_CASE)).cast("long")


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """win (array of words), items (array of structs of an item id as text, which may be null): the different windows of the items."""
    items = benchmark.select(F.struct(F.col("item_id").cast("string").alias("id")).alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    wins = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("win"))
    return wins.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _within(rows: DataFrame, n: int, names: list[str]) -> DataFrame:
    """rows with a broadcast hint if they are at most n, as counted before; a larger side is joined by shuffle."""
    return F.broadcast(rows.select(*names)) if rows.limit(n + 1).count() <= n else rows.select(*names)


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, text_hash, start, len, items: each occurrence of a window in a text of docs (doc_id, text).

    Word counts of the windows' words are taken in one pass over all texts, and so is every window's rarest word. Windows
    are then placed in the texts in blocks that may be broadcast, one pass each: a benchmark of up to `block` windows takes one.
    """
    wins = stored(item_windows(benchmark, size).withColumn("key", F.xxhash64("win")), "windows")
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    tokens = _within(stored(wins.select(F.explode("win").alias("token")).distinct(), "tokens"), size * block, ["token"])
    often = split.select(F.explode("w").alias("token")).join(tokens, "token").groupBy("token").count()
    ranked = wins.select("key", "win", "items", F.posexplode("win").alias("offset", "token")).join(often, "token")
    rarest = ranked.groupBy("key", "win", "items").agg(F.min(F.struct("count", "token", "offset")).alias("r"), F.count("*").alias("seen")).where(F.col("seen") == F.size("win"))
    prefix = stored(rarest.select("key", F.col("r.token").alias("token"), F.col("r.offset").alias("offset"), "win", F.size("win").alias("len"), "items"), "prefix")
    placed = split.select("doc_id", "text_hash", "w", F.posexplode("w").alias("pos", "token"))
    start = F.col("pos") - F.col("offset")
    hit = (start >= 0) & (start + F.col("len") <= F.size("w")) & (F.slice("w", start + 1, F.col("len")) == F.col("win"))
    blocks, found = max(1, -(-prefix.count() // block)), None
    for i in range(blocks):
        own = prefix.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i) if blocks > 1 else prefix
        part = placed.join(F.broadcast(own.drop("key")), "token").where(hit).select("doc_id", "text_hash", start.alias("start"), "len", "items")
        found = part if found is None else found.union(part)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, keep: list[str] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (their ids, sorted as text), contaminated for each row of docs, and the columns in keep.

    A document word inside an occurrence of an item's window is hit; a text is contaminated if at least a twentieth of its
    words are. An item shorter than the window is one window; one without words none. Null and empty texts have no words
    and are clean. Items of a null id count like others, as one item, but are not in `items`. Repeated rows get the same result,
    empty tables none or clean ones; other columns are ignored.
    """
    found = matches(docs, benchmark, size)
    spans = F.array_sort(F.collect_set(F.struct("start", "len")))
    by_doc = found.groupBy("doc_id", "text_hash").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    def step(acc: Column, s: Column) -> Column:
        end = s["start"] + s["len"]
        return F.struct((acc["hit"] + F.greatest(end - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("hit"), F.greatest(end, acc["end"]).alias("end"))

    hits = F.aggregate("spans", F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end")), step, lambda acc: acc["hit"])
    told = by_doc.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), hits.cast("long").alias("n_hit"), "items")
    names = ["doc_id", *keep]
    own = docs.select(*names, F.xxhash64("text").alias("text_hash"), n_words(F.col("text")).alias("n_words"))
    joined = own.join(told, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    found = F.coalesce("items", F.array().cast("array<struct<id:string>>"))
    items = F.array_compact(F.transform(found, lambda x: x["id"]))
    return joined.select(*names, "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), items.alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
