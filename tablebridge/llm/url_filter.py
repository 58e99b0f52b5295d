"""URL filters over a sorted digest array.

The rules' 64-bit xxhash keys lie sorted in a memory-mapped array. A URL is probed with the keys of its host's suffixes and
its path's prefixes by vectorised binary search, and each hit is confirmed on the stored full string.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: (host, path, verdict)
Rule = tuple[str, str, str]
SEED = 42


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty without `://`."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:stop]


class DigestArray:
    """Sorted keys with their strings and verdicts, in one file that is memory-mapped."""

    def __init__(self, data: np.ndarray):
        n = int(data[:8].view(np.uint64)[0])
        self.keys = data[8 : 8 + 8 * n].view(np.uint64)
        self.ends = data[8 + 8 * n : 8 + 16 * n].view(np.uint64)
        self.verdicts = data[8 + 16 * n : 8 + 17 * n]
        self.strings = data[8 + 17 * n :]

    @staticmethod
    def build(rules: list[Rule]) -> bytes:
        """Of rules with the same host and path the last one counts."""
        last = {h + "/" * (not p.startswith("/")) + p: v for h, p, v in rules}
        rows = sorted((xxhash.xxh64_intdigest(s, SEED), s.encode(), v) for s, v in last.items())
        ends = np.cumsum([len(s) for _, s, _ in rows], dtype=np.uint64)
        keys = np.array([k for k, _, _ in rows], np.uint64)
        marks = bytes(v == "block" for _, _, v in rows)
        return np.array([len(rows)], np.uint64).tobytes() + keys.tobytes() + ends.tobytes() + marks + b"".join(s for _, s, _ in rows)

    @classmethod
    def mapped(cls, data: bytes) -> DigestArray:
        handle, path = tempfile.mkstemp(suffix=".digests")
        try:
            with os.fdopen(handle, "wb") as file:
                file.write(data)
            return cls(np.memmap(path, np.uint8, "r"))
        finally:
            os.unlink(path)  # the mapping stays valid

    def string(self, i: int) -> bytes:
        return self.strings[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])].tobytes()

    def look_up(self, probes: list[str]) -> list[str | None]:
        """The verdict of each probe that is a stored string, else None."""
        wanted = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, wanted)
        out: list[str | None] = [None] * len(probes)
        for j in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == wanted) if len(self.keys) else []):
            i, own = int(at[j]), probes[j].encode()
            while i < len(self.keys) and self.keys[i] == wanted[j]:
                if self.string(i) == own:
                    out[j] = "block" if self.verdicts[i] else "allow"
                    break
                i += 1
        return out


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url).

    A rule (host, path, block or allow) fits its host and all subdomains if the URL's path starts with the rule's; the longest
    fitting rule decides, `default` where none fits. A null URL and one without `://` have an empty host and path. The rules are the caller's own list. Other columns are ignored.
    """
    data = pages.sparkSession.sparkContext.broadcast(DigestArray.build(rules))
    lengths = sorted({len(p) if p.startswith("/") else len(p) + 1 for _, p, _ in rules})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = DigestArray.mapped(data.value)
        for batch in batches:
            split = [split_url(u) for u in batch.column("url").to_pylist()]
            probes: list[str] = []
            owner: list[int] = []
            for row, (host, path) in enumerate(split):
                labels = host.split(".")
                own = [".".join(labels[i:]) + path[:n] for i in range(len(labels)) for n in lengths if n <= len(path)] if host else []
                probes += own
                owner += [row] * len(own)
            rule: list[str | None] = [None] * len(split)
            verdict = [default] * len(split)
            for row, probe, found in zip(owner, probes, digests.look_up(probes), strict=True):
                if found and (rule[row] is None or len(probe) > len(rule[row])):
                    rule[row], verdict[row] = probe, found
            made = [pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *made], ["page_id", "host", "path", "rule", "verdict"])

    source = pages.select("page_id", "url")
    return source.mapInArrow(run, f"page_id {dict(source.dtypes)['page_id']}, host string, path string, rule string, verdict string")
