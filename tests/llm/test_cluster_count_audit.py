"""Centroid clustering, token counts and the source audit against brute force, and their edge cases."""

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tablebridge.llm import centroids, divergence, token_counts
from tablebridge.llm.common import read, text_batches

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module", autouse=True)
def batches(spark):
    text_batches(spark)


# Centroids


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centers = [v for _, v in first]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), i) for i, c in enumerate(centers))

    for _ in range(rounds):
        own = [(nearest(v)[1], v) for _, v in kept]
        for i in range(len(centers)):
            if mine := [v for j, v in own if j == i]:
                centers[i] = [sum(x) // len(mine) for x in zip(*mine)]
    told = [(i, *nearest(v)[::-1]) for i, v in kept]
    per = Counter()
    for _, c, d in told:
        per[c] += d
    fit = lambda x: x if x < 1 << 63 else None
    return Counter((i, c, fit(d), fit(per[c]), fit(sum(per.values())), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for i, c, d in told)


def clusters(df, **options):
    return Counter(tuple(r) for r in centroids.cluster(df, **options).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


@pytest.mark.parametrize("case", ["spread", "ties", "wide", "edges"])
def test_centroids_are_those_of_brute_force(spark, case):
    rng, dims = random.Random(case), 6
    rows = [(i, [rng.gauss(0, 1) + 3 * (i % 4) for _ in range(dims)]) for i in range(200)]
    if case == "ties":
        rows = [(i, [float(rng.randrange(2)) for _ in range(dims)]) for i in range(200)]
    if case == "wide":
        rows += [(1000 + i, [rng.choice([1e300, -3e38, 2.0**60, 5e8, 0.1]) for _ in range(dims)]) for i in range(25)]
    if case == "edges":
        bad = [None, [], [1.0] * 5, [1.0] * 7, [1.0] * 5 + [None], [1.0] * 5 + [math.nan], [math.inf] + [1.0] * 5]
        rows = [(1, [0.5] * dims)] * 30 + [(None, [0.25 * j] * dims) for j in range(5)] + [(9, [1.0] * dims), (9, [-1.0] * dims)] + [(50 + i, v) for i, v in enumerate(bad)]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "vec_id long, embedding array<double>, cluster string, distance int")
    assert clusters(df, k=7, rounds=3, dims=dims, pivots=4) == brute_clusters(rows, 7, 3, dims)


def test_centroids_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert clusters(df) == clusters(df.limit(0)) == Counter()
    assert centroids.cluster(df).dtypes[0] == ("vec_id", "bigint")


def test_bounds_spare_comparisons_and_hold():
    rng = np.random.default_rng(4)
    middles = rng.integers(-300, 300, (40, 64))
    vectors = middles[rng.integers(0, 40, 3000)] + rng.integers(-20, 20, (3000, 64))
    simplex = centroids.Simplex(middles, 16)
    assert simplex.pivots.shape == (16, 64)
    now = centroids.Centroids(middles.tolist(), simplex)
    numbers, distances = now.nearest(vectors, simplex.apexes(vectors))
    exact = ((vectors[:, None] - middles[None]) ** 2).sum(axis=2)
    assert numbers == exact.argmin(axis=1).tolist() and distances == exact.min(axis=1).tolist()
    assert now.compared < 3000 * 40 / 10
    low, high, slack = centroids._bounds(simplex.apexes(vectors), simplex.apexes(middles))
    assert (low - slack <= exact).all() and (exact <= high + slack).all()


def test_simplex_leaves_out_pivots_inside_the_span_of_others():
    line = np.array([[0, 0, 0], [4, 0, 0], [8, 0, 0], [8, 0, 0], [0, 3, 0]])
    simplex = centroids.Simplex(line, 5)
    assert len(simplex.pivots) == 3
    assert np.allclose(simplex.apexes(np.array([[1, 1, 7]]))[0] @ np.ones(3) - 7, simplex.apexes(np.array([[1, 1, 0]]))[0] @ np.ones(3))


# Token counts


def brute_counts(texts):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return Counter((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in texts)


def test_token_counts_of_whole_texts(spark):
    docs = read(spark, SF, "documents")
    got = token_counts.count_tokens(docs, token_counts.Tokenizer(MODEL))
    assert Counter(map(tuple, got.collect())) == brute_counts(docs.select("doc_id", "text").collect())


def test_token_counts_of_odd_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    texts = [(1, None), (2, ""), (3, " "), (4, " \n\t "), (5, "a<s>b</s> <unk> <0x0A>"), (6, "日本 ﬁ Ａ́ \U0001f600"), (None, "x"), (None, "x"), (7, "x"), (7, "y"), (8, long), (9, long), (10, "nul \0 in it"), (11, "  two  gaps ")]
    texts += [(100 + i, "the same text") for i in range(3000)]
    df = spark.createDataFrame([(*t, "clash", b"1", 3) for t in texts], "doc_id long, text string, n_tokens string, digest binary, row int")
    got = token_counts.count_tokens(df, token_counts.Tokenizer(MODEL))
    assert Counter(map(tuple, got.collect())) == brute_counts(texts)
    assert token_counts.count_tokens(df.limit(0), token_counts.Tokenizer(MODEL)).count() == 0


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_token_cache_encodes_only_different_misses(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(token_counts, "BROADCAST_DIGESTS", broadcast)
    tokenizer, cache, sent = token_counts.Tokenizer(MODEL), f"file://{tmp_path}/cache", []
    encode = token_counts.encoded
    monkeypatch.setattr(token_counts, "encoded", lambda texts, t: (sent.append(sorted(r["text"] for r in texts.collect())), encode(texts, t))[1])
    docs = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = []
    for rows in (docs("a", "a", "b"), docs("b", "c", "c", None), docs("a", "b", "c")):
        told.append(sorted(map(tuple, token_counts.count_tokens(rows, tokenizer, cache).collect())))
    assert sent == [["a", "b"], ["", "c"], []]
    assert [len(x) for x in told] == [3, 4, 3]
    # another tokenizer shares nothing with it
    other = token_counts.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert other.version != tokenizer.version
    token_counts.count_tokens(docs("a", "<|endoftext|> b"), other, cache).collect()
    assert sent[-1] == ["<|endoftext|> b", "a"]
    # rows that two runs have both appended count once
    spark.read.parquet(f"{cache}/tokenizer={tokenizer.version}").write.mode("append").parquet(f"{tmp_path}/twice")
    for _ in range(2):
        spark.read.parquet(f"{tmp_path}/twice").write.mode("append").parquet(f"{cache}/tokenizer={tokenizer.version}")
    assert sorted(map(tuple, token_counts.count_tokens(docs("a", "b", "c"), tokenizer, cache).collect())) == told[2]


def test_token_counts_by_a_normal_form(spark, tmp_path):
    tokenizer = token_counts.Tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    lower = lambda text: F.lower(token_counts.filled(text))
    df = spark.createDataFrame([(1, "Hello THERE"), (2, "hello there"), (3, None)], "doc_id long, text string")
    got = token_counts.count_tokens(df, tokenizer, f"file://{tmp_path}/c", normal=lower)
    assert sorted(map(tuple, got.collect())) == [(1, 11, 2, False), (2, 11, 2, False), (3, 0, 0, False)]
    assert token_counts.cached(spark, f"file://{tmp_path}/c", tokenizer.version).count() == 2


def test_tokenizer_of_unknown_kind():
    with pytest.raises(ValueError, match="no library"):
        token_counts.Tokenizer("/tmp/vocabulary.txt")


# Source audit


def brute_audit(rows, top=200):
    def words(text):
        out, now = [], ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or ord(c) > 0x7F:
                now += c.lower() if c < "\x80" else c
            elif now:
                out, now = [*out, now], ""
        return out

    docs = [(lang or "", source or "", words(text)) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        of = Counter(w for d in mine for w in set(d[2]))
        kept = sorted(w for w, n in of.items() if n >= 3)
        sources = sorted({d[1] for d in mine})

        def shares(times):
            n = sum(times[w] for w in kept)
            return {w: 1 + 10**9 * (times[w] + 1) // (n + len(kept)) for w in kept}

        times = {s: Counter(w for d in mine if d[1] == s for w in d[2]) for s in sources}
        p, q = {s: shares(times[s]) for s in sources}, shares(Counter(w for d in mine for w in d[2]))
        for s in sources:
            pairs = [(sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in sources if o != s]
            own = [((p[s][w] - q[w]) ** 2 // q[w], w) for w in kept if times[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", own)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked[: top if part == "term" else None], 1)]
    return Counter(out)


def audited(df, **options):
    return Counter(map(tuple, divergence.audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect()))


def texts_of(seed, n=150):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Ab", "cd", "É", "日本", "zz") for b in "abcdefghijkl"]
    return [(" ".join(rng.choice(words[rng.randrange(2) * 20 :]) for _ in range(rng.randrange(30))), rng.choice(["en", "de"]), rng.choice("abcdef")) for _ in range(n)]


@pytest.mark.parametrize("bits", [64, 5, 1])
def test_audit_is_that_of_brute_force_even_where_digests_meet(spark, bits):
    rows = texts_of(1)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, item string, rank int")
    assert audited(df, bits=bits) == brute_audit(rows)
    assert audited(df, bits=bits, top=3) == brute_audit(rows, 3)


def test_audit_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "VOCABULARY", 30)
    monkeypatch.setattr(divergence, "ROWS", 7)
    monkeypatch.setattr(divergence, "PAIRS", 5)
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", 3)
    rows = texts_of(2)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert audited(df) == brute_audit(rows)


def test_audit_of_edges(spark):
    rows = [(None, None, None), ("", "en", "a"), ("one One ONE", "en", None), ("one", "en", "a"), ("one", "en", "a"), ("one two", "en", "b"), ("rare", "fr", "a"), ("", "fr", "b"), ("x" * 200_000, "en", "b"), ("a1b2c3 d-e_f", "de", "a"), ("a b", "de", "a"), ("A B", "de", "a")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    got = audited(df)
    assert got == brute_audit(rows)
    assert {r for r in got if r[0] == "fr"} == {("fr", "a", "pair", "b", 0, 1), ("fr", "b", "pair", "a", 0, 1)}
    assert audited(df.limit(0)) == Counter()


def test_shares_are_exact_beyond_decimals_of_doubles(spark):
    for n, total in ((0, 1), (9 * 10**14 - 1, 9 * 10**14), (123456789012345, 899999999999999), (6, 7), (1, 10**15)):
        got = spark.range(1).select(F.expr(divergence._share(f"{n}L", f"{total}L"))).first()[0]
        assert got == 1 + 10**9 * (n + 1) // total
