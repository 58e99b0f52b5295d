"""Personal data by weak supervision.

Fixed patterns give the base spans, which are always kept. Wider patterns propose further candidates; regex, gazetteer,
context, shape and edge labelers vote for or against every candidate, expectation-maximisation over the counts of vote
patterns of all documents estimates how reliable each labeler is, and a logistic span classifier decides which candidates to
add. It is trained on the posteriors, but sees what no labeler does: the span's characters and the words around it.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablebridge.llm.common import stored

KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
# The base patterns. A match cannot start inside a run of digits, so the lookbehind changes no result; it avoids rescans of long runs.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Wider candidate patterns.
_SPOKEN = re.compile(r"(?i)\b[a-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[a-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?[a-z0-9-]{1,63}){1,4}")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_DIGITS = re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,64}(?![A-Za-z0-9])")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|sk-[A-Za-z0-9]{20,255}|eyJ[A-Za-z0-9_-]{10,4000}\.[A-Za-z0-9_-]{10,4000}\.[A-Za-z0-9_-]{5,4000})(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
# What before a candidate says that it is something else.
_OTHER = re.compile(r"(?:#|\b(?:v|ver|no|nr|rev|isbn|issn|doi|sha|sha1|sha256|md5)[.:]? ?)$")
# Gazetteers and context cues by kind.
TOP_DOMAINS = frozenset("com org net edu gov io de fr es uk eu info".split())
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65")
CUES = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "account"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
    "secret": ("token", "secret", "key", "password", "passwd"),
    "ssn": ("ssn", "social security", "tax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
NOT_CUES = ("order", "invoice", "version", "commit", "checksum", "digest", "serial", "part number", "build")
LABELERS = 5
#: Spans of which the classifier learns, at most; hashed features, and how many a span has.
TRAIN_SPANS = 20_000
BITS, FEATURES = 12, 12


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum((2 * int(c)) // 10 + (2 * int(c)) % 10 for c in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern, found from each @ so that long runs cost no rescans."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the wider patterns."""
    out = []
    if "at" in text or "AT" in text:
        out += [(m.start(), 0, m.end()) for m in _SPOKEN.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _DIGITS.finditer(text)]
    out += [(m.start(), 3, m.end()) for m in _LOCAL_PHONE.finditer(text)]
    out += [(m.start(), 4, m.end()) for p in (_SECRET, _KEY) for m in p.finditer(text)]
    out += [(m.start(), 5, m.end()) for m in _SSN.finditer(text)]
    out += [(m.start(), 6, m.end()) for m in _IBAN.finditer(text)]
    return out


def iban(text: str) -> bool:
    """Whether the check digits of an account number are right."""
    turned = text.replace(" ", "")
    turned = turned[4:] + turned[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def pattern(text: str, start: int, kind: int, end: int, base: bool) -> int:
    """The labelers' votes on a span (0 abstains, 1 for, 2 against), as one number in base 3."""
    span, name = text[start:end], KINDS[kind]
    digits = [c for c in span if c in "0123456789"]
    before = text[max(0, start - 32) : start].lower()
    strict = base or (kind == 4 and _KEY.fullmatch(span) is not None)
    regex = 2 if _OTHER.search(before) else 1 if strict else 0
    gazetteer = 0
    if kind == 0:
        gazetteer = 1 if re.split(r"[^A-Za-z0-9]+", span.rstrip(")]"))[-1].lower() in TOP_DOMAINS else 2
        shape = 1 if len(span) >= 6 else 2
    elif kind == 1:
        shape = 1 if span.count(".") == 3 else 2
    elif kind == 2:
        gazetteer = 1 if "".join(digits).startswith(CARD_STARTS) else 2
        shape = 1 if luhn("".join(digits)) else 2
    elif kind == 3:
        gazetteer = 1 if "555" in span or span.startswith("+") else 0
        shape = 1 if len(digits) >= 10 else 2
    elif kind == 4:
        shape = 1 if len(set(span)) >= 8 else 2
    elif kind == 5:
        shape = 2 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 1
    else:
        shape = 1 if iban(span) else 2
    context = 1 if any(c in before for c in CUES[name]) else 2 if any(c in before for c in NOT_CUES) else 0
    around = text[start - 1 : start] + text[end : end + 1]
    edges = 2 if any(c.isalnum() for c in around) else 1
    votes = 0
    for v in (regex, gazetteer, context, shape, edges):
        votes = votes * 3 + v
    return votes


_CLASS = str.maketrans({**dict.fromkeys("0123456789", "d"), **dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "a"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A")})
_AROUND = re.compile(r"[^\W_]+|[^\s\w]")


def features(text: str, start: int, kind: int, end: int) -> list[int]:
    """FEATURES hashed features of a span: its kind with its length, its characters by class and its ends, and the words and signs around it."""
    span = text[start:end]
    shape = re.sub(r"(.)\1+", r"\1+", span.translate(_CLASS))
    left = _AROUND.findall(text[max(0, start - 40) : start].lower())[-3:]
    right = _AROUND.findall(text[end : end + 30].lower())[:2]
    left, right = ["", "", "", *left][-3:], [*right, "", ""][:2]
    words = [w for w in left if w.isalpha()]
    told = ("k", f"n{len(span)}", f"s{shape[:24]}", f"b{span[:2]}", f"e{span[-1:]}", f"l{left[2]}", f"m{left[1]}", f"o{left[0]}", f"r{right[0]}", f"t{right[1]}", f"w{words[-1] if words else ''}", f"v{len(set(span)) // 3}")
    return [xxhash.xxh32_intdigest(f"{kind}{x}") >> (32 - BITS) for x in told]


def _votes(code: int) -> list[int]:
    votes, out = code, []
    for _ in range(LABELERS):
        out.append(votes % 3)
        votes //= 3
    return out[::-1]


def found_spans(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, and spans: array of (start, kind, end, code, base, features)."""
    names = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("code", pa.int32()), ("base", pa.bool_()), ("features", pa.list_(pa.int32()))]))
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                for i, c in enumerate(counts):
                    c.append(sum(x[1] == i for x in base))
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest())

                def made(a: int, k: int, b: int, strict: bool) -> dict:
                    return {"start": a, "kind": k, "end": b, "code": pattern(text, a, k, b, strict), "base": strict, "features": features(text, a, k, b)}  # noqa: B023

                own = [made(a, k, b, True) for a, k, b in base]
                last = 0
                starts, far = [x[0] for x in base], list(itertools.accumulate((x[2] for x in base), max))
                for a, k, b in sorted(candidates(text)) if text else []:
                    before = bisect.bisect_left(starts, b)  # base spans that begin before the candidate ends
                    if a >= last and not (before and far[before - 1] > a):
                        own.append(made(a, k, b, False))
                        last = b
                spans.append(own)
            columns = [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    source = docs.select(*names, *(["text"] if "text" not in keep else []))
    fields = ", ".join(f"`{c}` {dict(source.dtypes)[c]}" for c in names)
    return source.mapInArrow(run, f"{fields}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans array<struct<start:int,kind:int,end:int,code:int,base:boolean,features:array<int>>>")


def reliabilities(rows: list[tuple[int, int, int]], rounds: int = 50) -> dict[tuple[int, int], float]:
    """Posterior that a candidate is personal data, by (kind, code), from (kind, code, count) by expectation-maximisation.

    Each labeler has one vote distribution for either class, each kind a prior; the classes start from the majority of votes.
    """
    votes = np.array([_votes(code) for _, code, _ in rows])
    kinds, n = np.array([k for k, _, _ in rows]), np.array([c for _, _, c in rows], float)
    post = np.clip(0.5 + 0.2 * ((votes == 1).sum(axis=1) - (votes == 2).sum(axis=1)), 0.05, 0.95)
    for _ in range(rounds):
        logs = np.zeros((2, len(rows)))
        for cls, weight in ((0, (1 - post) * n), (1, post * n)):
            for j in range(LABELERS):
                table = np.bincount(votes[:, j], weight, 3) + 1.0
                logs[cls] += np.log(table / table.sum())[votes[:, j]]
            prior = np.bincount(kinds, weight, len(KINDS)) + 1.0
            logs[cls] += np.log(prior / (np.bincount(kinds, n, len(KINDS)) + 2.0))[kinds]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return {(k, code): float(p) for (k, code, _), p in zip(rows, post, strict=True)}


def classifier(x: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1.0) -> np.ndarray:
    """Weights of the hashed features, the bias last, of a logistic classifier for spans with features x [spans, FEATURES] and posteriors y."""
    w, size = np.zeros((1 << BITS) + 1), 1 << BITS
    x = np.concatenate([x, np.full((len(x), 1), size)], axis=1)
    seen = np.bincount(x.ravel(), minlength=size + 1)
    step = 4.0 / (x.shape[1] * (seen + 4 * ridge))  # a bound on the curvature in each direction
    last, speed = w, np.zeros_like(w)
    for _ in range(rounds):
        ahead = w + 0.9 * speed
        p = 1 / (1 + np.exp(-np.clip(ahead[x].sum(axis=1), -30, 30)))
        w, last = ahead + step * (np.bincount(x.ravel(), np.repeat(y - p, x.shape[1]), size + 1) - ridge * ahead * (np.arange(size + 1) < size)), w
        speed = w - last
    return w


def find(docs: DataFrame, keep: list[str] = (), threshold: float = 0.5, train: int = TRAIN_SPANS) -> DataFrame:
    """Personal data of every row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and the columns named in keep.

    spans is an array of (start, kind, end), in code points with the end exclusive, kind an index into KINDS, sorted: the
    base spans and the added ones that overlap no base span. A null text is an empty one and has none; repeated rows get
    equal results, an empty table gives none. Vote patterns are counted over all documents; there are at most 7 * 3 ** 5 of
    them, whatever the input. The classifier learns from `train` spans at most, those with a vote whose hashes are lowest, and judges all.
    """
    found = stored(found_spans(docs, keep), "spans")
    each = found.select("doc_id", "base_sha256", F.explode("spans").alias("s"))
    counted = each.groupBy("s.kind", "s.code").count().orderBy("kind", "code")
    rows = [tuple(r) for r in counted.collect()]
    kept = F.col("spans")
    if rows:
        post = reliabilities(rows)
        spans = each.select("s.kind", "s.code", "s.features", F.xxhash64("doc_id", "base_sha256", "s.start").alias("h"))
        # spans on which regex, gazetteer and context all abstain teach nothing: the classifier carries over to them
        voted = F.col("code") >= 3 ** (LABELERS - 3)
        sample = spans.where(voted if any(code >= 3 ** (LABELERS - 3) for _, code, _ in rows) else F.lit(True)).orderBy("h", "kind", "code").limit(train).collect()
        w = classifier(np.array([r["features"] for r in sample]), np.array([post[r["kind"], r["code"]] for r in sample]))
        weights = F.from_json(F.lit(json.dumps([round(float(v), 6) for v in w[:-1]])), "array<double>")
        least = math.log(threshold / (1 - threshold)) - float(w[-1])
        total = lambda s: F.aggregate(s["features"], F.lit(0.0), lambda acc, i: acc + F.get(weights, i))
        kept = F.filter("spans", lambda s: s["base"] | (total(s) >= least))
    return found.withColumn("spans", F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))))


def spans_text(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first counts, and what the later ones cover beyond it goes too."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.get(names, s["kind"]))
        return F.struct(F.when(fresh, piece).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)
