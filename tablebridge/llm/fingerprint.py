"""Context-triggered piecewise hashing: a rolling hash over the bytes sets chunk ends, each chunk gives one signature character."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablebridge.llm.common import stored

WINDOW = 7
LEAST_BLOCK = 3
LENGTH = 64
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_R = np.uint64(0xD1342543DE82EF95)
_R_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        step = np.full(max(n, 2 * len(_powers[name])), _R if name == "up" else _R_INVERSE)
        step[0] = 1
        _powers[name] = np.cumprod(step, dtype=np.uint64)
    return _powers[name][:n]


def fingerprint(text: str | None) -> str:
    """block:signature:signature at twice the block, of the whole text's UTF-8 bytes; a null text is an empty one.

    The block size is 3 * 2 ** k, the least at which at most 64 chunks end.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    if not n:
        return f"{LEAST_BLOCK}::"
    wide = data.astype(np.uint32) + np.uint32(1)
    roll = np.zeros(n, np.uint32)
    factor = 1
    for i in range(min(WINDOW, n)):
        roll[i:] += wide[: n - i] * np.uint32(factor)
        factor = factor * 0x01000193 & 0xFFFFFFFF
    roll ^= roll >> np.uint32(15)
    block = LEAST_BLOCK
    while block * LENGTH * 2 < n:
        block *= 2
    while True:
        ends = np.flatnonzero(roll % np.uint32(block) == np.uint32(block - 1))
        if len(ends) <= LENGTH:
            break
        block *= 2
    while len(ends) < LENGTH // 2 and block > LEAST_BLOCK:
        less = np.flatnonzero(roll % np.uint32(block // 2) == np.uint32(block // 2 - 1))
        if len(less) > LENGTH:
            break
        block, ends = block // 2, less
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("down", n), dtype=np.uint64)])
    up = _power("up", n)

    def signature(ends: np.ndarray) -> str:
        stop = ends + 1 if len(ends) and ends[-1] == n - 1 else np.append(ends + 1, n)
        start = np.concatenate([[0], stop[:-1]])
        h = (sums[stop] - sums[start]) * up[stop - 1]
        h = (h ^ (h >> np.uint64(32))) * _R
        return ALPHABET[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode()

    double = ends[(roll[ends] % np.uint32(2 * block)) == np.uint32(2 * block - 1)]
    return f"{block}:{signature(ends)}:{signature(double)}"


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1: one minus the edit distance over the longer length, of signatures of equal block size; 0 where none is equal."""

    def alike(x: Column, y: Column) -> Column:
        longer = F.greatest(F.length(x), F.length(y))
        return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longer)

    p, q = F.split(a, ":"), F.split(b, ":")
    block_a, block_b = p[0].cast("long"), q[0].cast("long")
    return (
        F.when(a == b, 1.0)
        .when(block_a == block_b, F.greatest(alike(p[1], q[1]), alike(p[2], q[2])))
        .when(block_a == 2 * block_b, alike(p[1], q[2]))
        .when(block_b == 2 * block_a, alike(p[2], q[1]))
        .otherwise(0.0)
        .cast("double")
    )


def edited(text: str, following: str) -> str:
    """The text whose last half, rounded down, is replaced by as many first code points of the following one, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIELDS = "doc_id {}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, edge string, text string, part int"


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(fingerprint, batch.column("text").to_pylist()), pa.string())], ["doc_id", "fingerprint"])

    source = docs.select("doc_id", "text")
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, fingerprint string")


def neighbours(docs: DataFrame) -> DataFrame:
    """Each row of docs (doc_id, text) with its edited text and the next row by ascending doc_id (after the last: the first).

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint, near_edited, near_next. Null texts are
    empty ones; rows of equal doc_id follow each other by text, a null doc_id comes first; a single row follows itself. Other
    columns are ignored. The texts are shuffled once, by range; only the first and last row of each range pass a second join.
    """
    kind = dict(docs.dtypes)["doc_id"]
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before = None
        types = [pa.int64(), *[pa.string()] * 6, pa.int32()]
        names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint", "edge", "text", "part"]

        def made(ids: list, rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], ["doc_id", *names])

        for batch in batches:
            id_type, ids, rows = batch.schema.field("doc_id").type, [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = fingerprint(text)
                if before is None:
                    ids.append(doc)
                    rows.append((len(text), None, own, None, None, "first", text, part))
                else:
                    new = edited(before[1], text)
                    ids.append(before[0])
                    rows.append((len(before[1]), hashlib.sha256(new.encode()).hexdigest(), before[2], fingerprint(new), own, None, None, part))
                before = doc, text, own
            if rows:
                yield made(ids, rows)
        if before is not None:
            yield made([before[0]], [(len(before[1]), None, before[2], None, None, "last", before[1], part)])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [edited(a, b) for a, b in zip(batch.column("text").to_pylist(), batch.column("following").to_pylist(), strict=True)]
            sha, fp = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new], pa.string()), pa.array([fingerprint(x) for x in new], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_chars"), sha, batch.column("fingerprint"), fp, batch.column("next_fingerprint")], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"])

    done = stored(ordered.mapInArrow(run, _FIELDS.format(kind)), "fingerprints")
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]
    parts = sorted(r["part"] for r in done.where("edge = 'first'").select("part").collect())
    follows = done.sparkSession.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, after int")
    first = done.where("edge = 'first'").select(F.col("part").alias("after"), F.col("text").alias("following"), F.col("fingerprint").alias("next_fingerprint"))
    last = done.where("edge = 'last'").select("doc_id", "n_chars", "fingerprint", "text", "part").join(follows, "part").join(first, "after")
    ends = last.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", "text", "following").mapInArrow(joined, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string")
    rows = done.where("edge IS NULL").select(*columns).union(ends.select(*columns))
    return rows.withColumns({"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("next_fingerprint"))})
