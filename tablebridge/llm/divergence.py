"""Source divergence audit: how far the vocabulary of each source is from that of the others of its language.

Terms are counted as 64-bit digests; their strings stay behind in the shared folder. For kept digests alone the least and the
greatest string are compared: where they differ, several terms share a digest, and their counts are split by string. Strings
come back only for the terms of the report.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablebridge.llm.common import bounded_broadcast, stored

#: Documents of a language that a kept term is in, ranks of the term report, the unit of a share.
LEAST_DOCS, TOP, UNIT = 3, 200, 1_000_000_000
#: Rows that may be broadcast, terms of documents and different terms that a task holds, rows of a batch, pairs of sources made at once.
BROADCAST_ROWS, HELD, VOCABULARY, ROWS, PAIRS = 1_000_000, 3_000_000, 1_000_000, 1 << 16, 1 << 20
# Fixed value: a term is a run of bytes other than these, A-Z in lower case. Every byte of a code point beyond ASCII is part of a term.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def digest_of(term: bytes, bits: int = 64) -> int:
    """A signed number of the lowest bits of the term's xxh3."""
    x = xxhash.xxh3_64_intdigest(term) & ((1 << bits) - 1)
    return x - (1 << 64) if x >= 1 << 63 else x


def _groups(docs: DataFrame) -> DataFrame:
    """lang, source, lid, gid of each group: 64-bit names of languages and groups, with a seed under which none is taken twice."""
    known = stored(docs.select("lang", "source").distinct(), "groups")
    n, languages = known.count(), known.select("lang").distinct().count()
    for seed in itertools.count():
        lid = F.xxhash64(F.lit(seed), F.lit(0), "lang")
        named = known.select("lang", "source", lid.alias("lid"), F.xxhash64(F.lit(seed), lid, "source").alias("gid"))
        told = named.agg(F.count_distinct("gid"), F.count_distinct("lid")).first()
        if tuple(told) == (n, languages):
            return named


class _Counts:
    """Terms of documents by group, numbered in a vocabulary; sums are taken over sorted numbers."""

    def __init__(self, bits: int, only: np.ndarray | None):
        self.bits, self.only = bits, only
        self.groups: dict[tuple[int, int], int] = {}
        self.forget()

    def forget(self) -> None:
        self.vocabulary: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.digests = np.zeros(0, np.int64)
        self.clear()

    def clear(self) -> None:
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.held = 0

    def add(self, lid: int, gid: int, text: bytes) -> None:
        words = terms(text)
        own, times = np.unique(np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words)), return_counts=True)
        self.keys.append(own + (self.groups.setdefault((lid, gid), len(self.groups)) << 32))
        self.times.append(times)
        self.held += len(own)

    def out(self) -> Iterator[pa.RecordBatch]:
        new = list(itertools.islice(self.vocabulary, len(self.digests), None))
        self.digests = np.append(self.digests, np.fromiter((digest_of(t, self.bits) for t in new), np.int64, len(new)))
        keys = np.concatenate([np.zeros(0, np.int64), *self.keys])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        n = np.add.reduceat(np.concatenate([np.zeros(0, np.int64), *self.times])[order], starts) if len(keys) else starts
        docs, own = np.diff(np.append(starts, len(keys))), keys[starts]
        at, group = own & 0xFFFFFFFF, np.array(list(self.groups), np.int64).reshape(-1, 2)[own >> 32]
        digests = self.digests[at]
        if self.only is None:
            yield from _batches([group[:, 0], group[:, 1], digests, n, docs, None], len(own))
            yield from _batches([None, None, self.digests[len(self.digests) - len(new) :], None, None, new], len(new))
        else:
            some, names = np.isin(digests, self.only), list(self.vocabulary)
            yield from _batches([group[some, 0], group[some, 1], digests[some], n[some], docs[some], [names[i] for i in at[some]]], int(some.sum()))
        self.clear()
        if len(self.vocabulary) > VOCABULARY:
            self.forget()


def _batches(columns: list, n: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ROWS rows of the columns of counted(); None is a column of nulls."""
    kinds = [pa.int64()] * 5 + [pa.binary()]
    for low in range(0, n, ROWS):
        cut = [pa.nulls(min(ROWS, n - low), t) if c is None else pa.array(c[low : low + ROWS], t) for c, t in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(cut, ["lid", "gid", "digest", "n", "docs", "term"])


def counted(docs: DataFrame, bits: int, only: list[int] | None = None) -> DataFrame:
    """Of docs (lid, gid, text) rows of counts (lid, gid, digest, n, docs) and rows of strings (digest, term).

    A task adds up its documents and writes a string once for as long as it remembers it; it holds about HELD terms of
    documents, and VOCABULARY strings beside theirs. With `only`, a list of digests, other terms are left out and rows of counts have their term.
    """
    wanted = None if only is None else np.array(only, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(bits, wanted)
        for batch in batches:
            for lid, gid, text in zip(batch.column("lid").to_pylist(), batch.column("gid").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                counts.add(lid, gid, text)
                if counts.held > HELD:
                    yield from counts.out()
        yield from counts.out()

    return docs.select("lid", "gid", "text").mapInArrow(run, "lid long, gid long, digest long, n long, docs long, term binary")


def _kept(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept terms (lid, digest, part, lang_n), their counts by group (lid, gid, digest, part, n), and their strings (digest, part, term). Terms that share a digest have different parts."""
    key = ["lid", "digest", "part"]
    whole = F.lit(0).alias("part")
    told = stored(counted(docs, bits), "terms")
    counts = told.where("gid IS NOT NULL").select("lid", "gid", "digest", whole, "n", "docs")

    def enough(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*key).agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).drop("docs")

    # a digest that several terms share is kept wherever one of them is
    kept = stored(enough(counts), "kept")
    digests = bounded_broadcast(kept.select("digest").distinct(), BROADCAST_ROWS)
    strings = told.where("gid IS NULL").select("digest", "term").join(digests, "digest", "left_semi")
    ends = stored(strings.groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("last")), "strings")
    shared = [r["digest"] for r in ends.where(F.col("term") != F.col("last")).select("digest").limit(BROADCAST_ROWS + 1).collect()]
    if len(shared) > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} digests of {bits} bits are shared by several terms; take more bits")
    texts = ends.select("digest", whole, "term")
    if shared:
        split = stored(counted(docs, bits, shared).groupBy("lid", "gid", "digest", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "split")
        order = F.row_number().over(Window.partitionBy("digest").orderBy("term"))
        parts = split.select("digest", "term").distinct().select("digest", order.alias("part"), "term")
        split = split.join(parts, ["digest", "term"]).select("lid", "gid", "digest", "part", "n", "docs")
        lone = ~F.col("digest").isin(shared)
        counts = counts.where(lone).union(split)
        texts = texts.where(lone).union(parts)
        kept = stored(enough(counts), "kept")
    of_kept = counts.join(bounded_broadcast(kept.select(*key), BROADCAST_ROWS), key, "left_semi")
    return kept, stored(of_kept.groupBy("gid", *key).agg(F.sum("n").alias("n")), "counts"), texts


def _share(count: str, total: str) -> str:
    """SQL of 1 + floor(UNIT * (count + 1) / total), by long division in steps of 1000: exact in 64 bits up to totals of 9e15."""
    first = f"(1000 * ({count} + 1))"
    second = f"(1000 * ({first} % {total}))"
    third = f"(1000 * ({second} % {total}))"
    return f"(1 + {first} div {total} * 1000000 + {second} div {total} * 1000 + {third} div {total})"


def _off(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / q)."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def _common(cells: DataFrame) -> DataFrame:
    """a, b, value: what terms that both groups have add to a pair beyond the sums of each side, from rows (cells: gid, p, p0 of the groups of one term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        off = lambda p, q: (p - q) ** 2 // q
        for batch in batches:
            lists = batch.column("cells")
            flat = lists.flatten()
            gids, p, p0 = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            names, own = np.unique(gids, return_inverse=True)
            ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
            sizes = np.diff(ends, prepend=0)
            width, start = np.repeat(sizes, sizes), np.repeat(ends - sizes, sizes)
            made = np.cumsum(width)
            low = 0
            while low < len(gids):
                high = max(low + 1, int(np.searchsorted(made, (made[low - 1] if low else 0) + PAIRS, "right")))
                w = width[low:high]
                i = np.repeat(np.arange(low, high), w)
                j = np.repeat(start[low:high], w) + np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)
                i, j = i[i != j], j[i != j]
                more = off(p[i], p[j]) - off(p[i], p0[j]) - off(p0[i], p[j]) + off(p0[i], p0[j])
                pairs, at = np.unique(own[i] * len(names) + own[j], return_inverse=True)
                value = np.zeros(len(pairs), np.int64)
                np.add.at(value, at, more)
                yield pa.RecordBatch.from_arrays([pa.array(names[pairs // len(names)]), pa.array(names[pairs % len(names)]), pa.array(value)], ["a", "b", "value"])
                low = high

    return cells.mapInArrow(run, "a long, b long, value long")


def _pairs(info: DataFrame, shares: DataFrame, kept: DataFrame) -> DataFrame:
    """a, b, value for all ordered pairs of groups of one language: the sum of floor((pa - pb)^2 / pb) over its kept terms.

    Most terms are in few groups, so a term costs the square of the groups that have it, not of all. The sum is taken first
    as if b had no term (by the different shares of a), then b's own terms as if a had none, then what terms of both change.
    """
    have = shares.groupBy("gid").agg(F.count("*").alias("terms"))
    none = info.join(have, "gid", "left").select("lid", "gid", F.col("p0").alias("p"), (F.col("v") - F.coalesce("terms", F.lit(0))).alias("m"), "p0", F.lit(False).alias("own"))
    some = shares.groupBy("lid", "gid", "p", "p0").agg(F.count("*").alias("m")).select("lid", "gid", "p", "m", "p0", F.lit(True).alias("own"))
    others = bounded_broadcast(info.select("lid", F.col("gid").alias("other"), F.col("p0").alias("q0")), BROADCAST_ROWS)
    met = some.union(none).join(others, "lid").where("gid <> other")
    as_a = F.struct(F.col("gid").alias("a"), F.col("other").alias("b"), F.expr(f"m * {_off('p', 'q0')}").alias("value"))
    as_b = F.struct(F.col("other").alias("a"), F.col("gid").alias("b"), F.expr(f"if(own, m * ({_off('q0', 'p')} - {_off('q0', 'p0')}), 0L)").alias("value"))
    sides = met.select(F.explode(F.array(as_a, as_b)).alias("x")).select("x.*")
    cells = shares.groupBy("lid", "digest", "part").agg(F.collect_list(F.struct("gid", "p", "p0")).alias("cells")).where(F.size("cells") > 1)
    return sides.union(_common(cells.select("cells"))).groupBy("a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, top: int = TOP, bits: int = 64) -> DataFrame:
    """lang, source, part, item, value, rank of docs (text, lang, source).

    Part `pair` has each other source of the language, its value the divergence from it over all kept terms; part `term` the
    terms that a source uses more than its language, at most `top` of them. Null text, language and source are empty ones.
    A language without kept terms has pairs of value 0 and no terms. Rows of equal value rank by item. Repeated rows count as
    often as they occur; an empty table gives no rows. Texts may have any length, other columns are ignored. Occurrences are exact up to 9e15.
    """
    filled = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    groups = _groups(filled)
    named = bounded_broadcast(groups, BROADCAST_ROWS)
    kept, counts, texts = _kept(filled.join(named, ["lang", "source"]), bits)
    languages = kept.groupBy("lid").agg(F.count("*").alias("v"), F.sum("lang_n").alias("total"))
    totals = counts.groupBy("gid").agg(F.sum("n").alias("n"))
    zero = F.lit(0).cast("long")
    info = groups.join(languages, "lid", "left").join(totals, "gid", "left")
    info = info.select("lid", "gid", "lang", "source", F.coalesce("v", zero).alias("v"), (F.coalesce("n", zero) + F.coalesce("v", zero)).alias("base"), (F.col("total") + F.col("v")).alias("lang_base"))
    info = stored(info.withColumn("p0", F.expr(f"if(v = 0, 1L, {_share('0L', 'greatest(base, 1L)')})")), "info")
    known = bounded_broadcast(info.drop("lang", "source"), BROADCAST_ROWS)
    shares = stored(counts.join(known.drop("lid"), "gid").select("lid", "gid", "digest", "part", F.expr(_share("n", "base")).alias("p"), "p0", "lang_base"), "shares")

    names = bounded_broadcast(info.select("gid", "lang", "source"), BROADCAST_ROWS)
    found = _pairs(info, shares, kept).join(names, F.col("a") == F.col("gid")).drop("gid")
    found = found.join(bounded_broadcast(info.select(F.col("gid").alias("b"), F.col("source").alias("item")), BROADCAST_ROWS), "b")
    by = Window.partitionBy("a").orderBy(F.desc("value"), "item")
    pairs = found.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by).alias("rank"))

    key = ["lid", "digest", "part"]
    told = shares.join(bounded_broadcast(kept, BROADCAST_ROWS), key).withColumn("q", F.expr(_share("lang_n", "lang_base"))).where("p > q")
    told = told.select("gid", "digest", "part", F.expr(_off("p", "q")).alias("value"))
    # ties at the end stay until their strings decide
    near = told.withColumn("place", F.rank().over(Window.partitionBy("gid").orderBy(F.desc("value")))).where(F.col("place") <= top)
    near = near.join(texts, ["digest", "part"]).select("gid", "value", F.col("term").cast("string").alias("item"))
    rank = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("value"), "item"))
    best = near.withColumn("rank", rank).where(F.col("rank") <= top).join(names, "gid")
    return pairs.union(best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
