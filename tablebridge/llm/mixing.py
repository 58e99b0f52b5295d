"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source has an exact quota of words. A binary tree over the output shards divides the quotas: a node's left half draws
its words from the node's quotas without replacement, so each shard's composition is a multivariate-hypergeometric draw and
all quotas come out exactly. The documents of a source lie, in an order permuted by hash, on a line of words that is
repeated until the quota is filled; each shard takes its own disjoint stretch of that line, and rows are shuffled within it.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablebridge.llm.common import bounded_broadcast, stored

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SHARDS = 16
SEED = 20
# Fixed value: a word is a run of code points other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one hash bucket of a source should hold, and the most buckets: beyond, buckets grow (their narrow rows are sorted with spill).
BUCKET_ROWS, MAX_BUCKETS = 128, 1 << 14
#: Sources that may be broadcast, and sources that a mix may have: their quotas are split on the driver, and more are an error.
BROADCAST_SOURCES, MAX_SOURCES = 100_000, 1_000_000


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Words to take of each source: `share` of all words by cyclic weight, none beyond `cap` times its size; the excess is shared again."""
    out = [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s > 0], share * sum(sizes)
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        full = [i for i in open_ if left * weights[i % len(weights)] / total > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i % len(weights)] / total
            break
        for i in full:
            out[i] = cap * sizes[i]
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
        left -= sum(out[i] for i in full)
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int, whole: int = 10**9) -> int:
    """How many good ones n draws without replacement give; exact at every size.

    The generator's own sampler ends below `whole`. Beyond it every item is first drawn by itself with probability n / all,
    two binomial draws. That gives a uniform choice of some k items; what k lacks of n, or exceeds it by, is about the root
    of n, and is drawn, or given back, at random among the rest in the same way.
    """
    given, sign = 0, 1
    while n > 0 and good > 0:
        if bad <= 0:
            return given + sign * min(n, good)
        if good + bad < whole:
            return given + sign * int(rng.hypergeometric(good, bad, n))
        if n <= 1000:
            for _ in range(n):
                hit = rng.random() * (good + bad) < good
                given, good, bad = given + sign * hit, good - hit, bad - (not hit)
            return given
        p = n / (good + bad)
        x, y = int(rng.binomial(good, p)), int(rng.binomial(bad, p))
        given += sign * x
        if x + y <= n:
            good, bad, n = good - x, bad - y, n - x - y  # draw the lacking ones among those left
        else:
            good, bad, n, sign = x, y, x + y - n, -sign  # give the excess back from those drawn
    return given


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """[sources, shards]: the words of each source that each shard takes; rows sum to the quotas, columns are equal to within a word."""
    out = np.zeros((len(quotas), shards), np.int64)

    def node(have: list[int], low: int, high: int) -> None:
        if high - low == 1:
            out[:, low] = have
            return
        mid = (low + high) // 2
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{low}:{high}".encode()).digest()[:8], "big"))
        rest, left, n = sum(have), [], sum(have) * (mid - low) // (high - low)
        for q in have:
            rest -= q
            left.append(_draw(rng, q, rest, n))
            n -= left[-1]
        node(left, low, mid)
        node([q - x for q, x in zip(have, left, strict=True)], mid, high)

    if quotas:
        node(list(quotas), 0, shards)
    return out


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, shards: int = SHARDS, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, keep: list[str] = ()) -> DataFrame:
    """The mix of docs (doc_id, text, source): one row per row of docs.

    doc_id, source, size (words of the text), source_size, target (of its source), taken (words that the mix takes of it,
    repeats counted), pieces: array of (shard, epoch, first, last), word ranges of the document with the end exclusive, text_hash and the columns in keep.
    Sources count by code point, null last and a source of its own. Null and empty texts have size 0 and no pieces. A source's taken
    words sum to its target, rounded; no document is taken more than `cap` times. Repeated rows count as often as they occur; ids may be null
    or repeated, as a row's place follows from its id and text. An empty table gives an empty mix. Other columns are ignored. Equal inputs give equal mixes.
    """
    spark = docs.sparkSession
    names = ["doc_id", "text_hash", *keep]
    rows_of = docs.withColumn("text_hash", F.xxhash64("text")).select(*names, F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))
    sized = stored(rows_of.drop(*keep), "sizes")
    # kept columns may be whole texts: they are read again instead of being stored once more
    rows_of = rows_of if keep else sized
    sums = stored(sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")), "sources")
    if (sources := sums.count()) > MAX_SOURCES:
        raise ValueError(f"{sources} sources; a mix has at most {MAX_SOURCES}")
    totals = sorted(((r["source"], int(r["words"] or 0), r["docs"]) for r in sums.collect()), key=lambda r: (r[0] is None, r[0] or ""))
    wanted = targets([r[1] for r in totals], weights, share, cap)
    quotas = [min(round(t), math.floor(cap * r[1])) for t, r in zip(wanted, totals, strict=True)]
    ends = np.cumsum(split_quotas(quotas, shards, seed), axis=1) if totals else np.zeros((0, shards), np.int64)
    rows = [(i, r[0], r[1], float(t), [0, *map(int, e)]) for i, (r, t, e) in enumerate(zip(totals, wanted, ends, strict=True))]
    plan = spark.createDataFrame(rows, "sid int, name string, source_size long, target double, bounds array<long>")

    buckets = 1
    while buckets < MAX_BUCKETS and buckets * BUCKET_ROWS < max((r[2] for r in totals), default=0):
        buckets *= 2
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_hash"))
    placed = rows_of.join(bounded_broadcast(plan.select("sid", "name"), BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("name"))).select(*names, "source", "size", "sid", h.alias("h"), F.pmod(F.shiftrightunsigned(h, 40), F.lit(buckets)).alias("bucket"))
    filled = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = filled.select("sid", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    lined = placed.join(offsets, ["sid", "bucket"]).withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))

    lined = lined.join(bounded_broadcast(plan.drop("name"), BROADCAST_SOURCES), "sid")
    epochs = F.sequence(F.lit(0), F.lit(max(0, math.ceil(cap) - 1)))

    def piece(epoch: Column, shard: Column) -> Column:
        at = epoch * F.col("source_size") + F.col("start")
        first, last = F.greatest(at, F.get("bounds", shard)) - at, F.least(at + F.col("size"), F.get("bounds", shard + 1)) - at
        return F.struct(shard.alias("shard"), epoch.alias("epoch"), first.alias("first"), last.alias("last"))

    cells = F.flatten(F.transform(epochs, lambda e: F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: piece(e, j))))
    pieces = F.filter(cells, lambda p: p["last"] > p["first"])
    lined = lined.select(*names, "source", "size", "source_size", "target", F.when(F.col("size") > 0, pieces).otherwise(F.filter(cells, lambda p: F.lit(False))).alias("pieces"))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["last"] - p["first"])
    return lined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "pieces", "text_hash", *keep)


def piece_text(text: Column, size: Column, first: Column, last: Column) -> Column:
    """The words first to last (exclusive) of a text with what stands between them; the whole text as it is."""
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), 0), first.cast("int") + 1, (last - first).cast("int")), " ")
    return F.when((first == 0) & (last == size), text).otherwise(cut)


def shard_rows(mixed: DataFrame, keep: list[str] = (), seed: int = SEED, parts: int = 64) -> DataFrame:
    """The drawn pieces of a mix as rows in the order of each shard, and the columns named in keep; with `text` among them each row has its piece's words.

    shard, place (its key in the local shuffle), doc_id, source, epoch, first, last, words. A shard is dealt into `parts`
    tasks by place, so a large one is shuffled by many. A whole document keeps its white space; a cut one has single spaces.
    """
    own = [c for c in keep if c not in ("doc_id", "source")]
    rows = mixed.select("doc_id", "source", "size", "text_hash", *own, F.explode("pieces").alias("p"))
    place = F.xxhash64(F.lit(seed), "doc_id", "text_hash", "p.epoch", "p.shard", "p.first")
    columns = [piece_text(F.col("text"), F.col("size"), F.col("p.first"), F.col("p.last")).alias("text") if c == "text" else F.col(c) for c in own]
    rows = rows.select("p.shard", place.alias("place"), "doc_id", "source", "p.epoch", "p.first", "p.last", (F.col("p.last") - F.col("p.first")).alias("words"), *columns)
    return rows.repartition("shard", F.pmod("place", F.lit(parts))).sortWithinPartitions("shard", "place")
