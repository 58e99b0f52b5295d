"""The operators against brute force, round trips, held-out accuracy and edge cases."""

import hashlib
import html
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tablebridge.llm import chat, common, decontaminate, fingerprint, html_text, language_id, mixing, ngram_join, pii, queries, toxicity, url_filter
from tablebridge.llm.common import fold, read, text_batches

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def batches(spark):
    text_batches(spark)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "documents pages benchmark labels conversations embeddings".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = db.sql(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall()
    assert Counter(map(tuple, df.select(*cols).collect())) == Counter(want)


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and a clashing extra column."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "  \n ", None, None, 3), (4, "one two", "en", None, 7), (4, "one two", "en", None, 7), (5, long, "de", "b", len(long)), (6, long, "de", "b", len(long)),
        (7, "ONE two", None, "b", 7), (None, "nobody knows", "en", "b", 12), (8, "1234 +++", "de", None, None), (9, "x" * 100_000 + "@", "en", "a", 100_001), (10, "1" * 50_000, "en", "a", 50_000),
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], DOCS + ", node string")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# Near duplicates


def brute_classes(docs, t=0.8):
    sets = {}
    for i, text in docs:
        w = (text or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) > 0):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in sets}


def near_texts(n, seed):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            words[rng.randrange(len(words))] = f"n{rng.random()}"
        out.append((i, " ".join(words)))
    return out + [(n + i, " ".join(f"z{i}{j}" for j in range(rng.randrange(1, 60))) + " " + " ".join(base[:20])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_finds_every_class(spark, seed):
    docs = near_texts(60, seed)
    got = ngram_join.ngram_join(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == brute_classes(docs)


def brute_links(docs, t=0.8):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, text.lower().split()) for i, text in docs)}
    return {i: sum(j != i and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) for j in sets) for i in sets}


def test_ngram_join_counts_every_link(spark):
    docs = near_texts(90, 3)
    docs += [(1000 + i, docs[i][1]) for i in range(0, 40, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_links(docs)
    assert max(want.values()) > 40
    got = {r["doc_id"]: r for r in ngram_join.classes(df).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == want
    uncounted = ngram_join.classes(df, count_links=False).collect()
    assert {r["doc_id"]: (r["component"], r["class_id"], r["n_links"]) for r in uncounted} == {i: (r["component"], r["class_id"], None) for i, r in got.items()}
    sets = ngram_join.gram_sets(df).dropDuplicates(["node"]).cache()
    ids = ngram_join.signatures(df).select("doc_id", "node").cache()
    members = ids.groupBy("node").agg(F.count("*").alias("copies")).withColumn("component", F.lit("all"))
    for block_nodes, block_grams in ((7, 1 << 20), (1000, 500)):
        told = ngram_join.linked_copies(members, sets, 0.8, block_nodes, block_grams)
        rows = ids.join(told, "node", "left").join(members.select("node", "copies"), "node").collect()
        assert {r["doc_id"]: (r["links"] or 0) + r["copies"] - 1 for r in rows} == want


def test_ngram_join_edges(spark, edge, nothing):
    got = {}
    for r in ngram_join.ngram_join(edge).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert len(got[4]) == 2 and got[7][0]["class_id"] == 4 and got[4][0]["n_links"] == 2
    assert got[1][0]["class_id"] == got[2][0]["class_id"] == got[3][0]["class_id"] == 1
    assert got[6][0]["class_id"] == 5
    assert ngram_join.ngram_join(nothing).count() == 0


def test_components_and_merged(spark):
    rng = random.Random(4)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)]
    edges = chain + [(f"r{rng.randrange(60):02}", f"r{rng.randrange(60):02}") for _ in range(45)] + [("hub", f"leaf{i}") for i in range(30)]
    rng.shuffle(edges)

    def brute(pairs):
        up = {x: x for p in pairs for x in p}
        for _ in pairs:
            for a, b in pairs:
                up[a] = up[b] = min(up[a], up[b])
        return {x: c for x, c in up.items()}

    def told(df):
        return {r["node"]: r["component"] for r in df.collect()}

    frame = lambda pairs: spark.createDataFrame(pairs, "a string, b string")
    real = [p for p in edges if p[0] != p[1]]
    first = ngram_join.components(frame(real[:60]))
    assert told(first) == brute(real[:60])
    assert told(ngram_join.merged(first, frame(real[60:]))) == brute(real)
    assert told(ngram_join.merged(first, frame([]))) == brute(real[:60])


def test_ngram_join_takes_ids_of_any_type(spark):
    text = " ".join(f"w{i}" for i in range(100))
    df = spark.createDataFrame([("b", text + " end"), ("a", text), ("x", "alone here")], "doc_id string, text string")
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(df).collect()} == {"b": ("a", 1), "a": ("a", 1), "x": ("x", 0)}


def test_hot_keys_are_split(spark):
    left = spark.range(5000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = left.groupBy("k").agg(F.max("v").alias("top"))
    assert common.hot_keys(left.groupBy("k").count(), "k", "count", 5000) == [7]
    joined = common.split_join(left, right, "k", "v")
    assert joined.count() == 5000 and joined.where("k = 7 AND top = 2999").count() == 3000 and joined.columns == ["k", "v", "top"]


def test_ngram_join_recall_on_documents(spark, db):
    """Every pair of at least the threshold among the documents is in one class."""
    docs = db.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    got = {r["doc_id"]: r["class_id"] for r in queries.op4_ngram_join(spark, SF).collect()}
    assert got == brute_classes(docs)


def test_ngram_join_links_rows_without_id(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(None, text + " end"), (3, text), (4, "alone here")]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {None: (3, 1), 3: (3, 1), 4: (4, 0)}


def test_bands_reach_the_recall():
    bands, rows = ngram_join.plan_bands(0.8, 0.9999, 256)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 256


def test_prefix_pairs_are_complete(spark):
    docs = near_texts(40, 5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = ngram_join.gram_sets(df).dropDuplicates(["node"]).cache()
    mixed = sets.select("node", F.col("node").alias("component"))
    found = {tuple(r) for r in ngram_join.verify(ngram_join._prefix_pairs(mixed, sets, 0.8), sets, 0.8).collect()}
    own = {r["node"]: set(r["grams"]) for r in sets.collect()}
    assert found == {(a, b) for a in own for b in own if a < b and len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])}


# Language


def test_suffix_automaton():
    rng = random.Random(1)
    for _ in range(100):
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 5))]
        subs = {w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        machine = language_id.SuffixAutomaton(words)
        for _ in range(20):
            text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))
            n, at = 0, 0
            while at < len(text):
                end = at + 1
                while end < len(text) and text[at : end + 1] in subs:
                    end += 1
                n, at = n + 1, end
            assert language_id.phrases(machine.start(), text) == n


def test_language_letters_and_models(spark):
    assert language_id.reduced("½ ² Ⅷ 12 + \u0301") == "" and language_id.reduced(None) == "" and language_id.reduced("Él, o2 ñu\u0303!") == " él o ñu\u0303 "
    a, b = {"x": [" aa bb aa "], "y": [" cc "]}, {"x": [" aa bb aa "], "y": [" bb aa bb aa "]}
    assert language_id._parsers(a)[1][1] != language_id._parsers(b)[1][1]  # models with the same ends are told apart
    assert language_id.phrases(language_id._parsers(a)[1][0], " aa bb ") == 1  # one phrase goes across words
    df = spark.createDataFrame([(1, "½²"), (2, "aa bb"), (2, "aa bb")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["lang_pred"]) for r in language_id.identify(df, a).collect()) == [(1, "und"), (2, "x"), (2, "x")]


def test_language_sample_is_bounded_by_language(spark):
    rows = [(i, f"{'abcdefgh'[i % 7]}word{i} " * 20, "xyz"[i % 3]) for i in range(900)] + [(None, "no id", "x"), (5000, None, "x"), (5001, "no language", None)]
    model = language_id.training_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=50, chars=4000)
    assert sorted(model) == ["x", "y", "z"] and all(1000 < sum(map(len, v)) <= 4000 and len(v) <= 50 for v in model.values())


def test_language_held_out(spark):
    docs = read(spark, SF, "documents")
    got = queries.op7_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, edge, nothing):
    got = [tuple(r) for r in language_id.identify(edge, language_id.learn(edge)).select("doc_id", "lang_pred").collect()]
    assert len(got) == 12 and {(1, "und"), (2, "und"), (3, "und"), (8, "und"), (10, "und")} <= set(got)
    assert language_id.identify(nothing, language_id.learn(nothing)).count() == 0


# Toxicity


SHORT_PAGE = "<h1>News of the day</h1><p>The river has risen and the people of the town were told to leave it.</p><p>It is said that the bridge will be closed for all of the week.</p>"


@pytest.mark.parametrize("page", [f"<body>{SHORT_PAGE}</body>", f'<div class="wrap">{SHORT_PAGE}</div>', f"<ul><li><a href=1>Home of all</a></ul>{SHORT_PAGE}<div class=footer>It is all of it the work of the town.</div>"])
def test_short_paragraphs_without_an_article_are_text(page):
    assert html_text.main_text(page) == "News of the day\nThe river has risen and the people of the town were told to leave it.\nIt is said that the bridge will be closed for all of the week."


def test_short_paragraphs_beside_an_article_are_judged_as_before():
    long = "The river has risen and the people of the town were told to leave it. " * 4
    assert html_text.main_text(f"<article><p>{long}</p></article><p>It is one of the many words of a page that is not of it.</p>") == long.strip()


def test_languages_of_long_texts_are_learned(spark):
    rng = random.Random(5)
    words = {"en": "the of and to in is that it was for".split(), "de": "der die und das nicht ist ein zu den mit".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, text("en", 30), "en") for i in range(60)] + [(100 + i, text("de", 4000), "de") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(df)
    assert sorted(model) == ["de", "en"] and max(len(t) for t in model["de"]) <= language_id.TRAIN_CHARS // 4 + 2
    assert sum(map(len, model["de"])) > language_id.TRAIN_CHARS / 2
    got = language_id.identify(df, model, keep=["lang"]).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)
    assert language_id.learn(df) == model


def test_targets_of_many_sources():
    sizes = [1 + i % 1000 for i in range(200_000)]
    got = mixing.targets(sizes)
    assert sum(got) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * s + 1e-6 for t, s in zip(got, sizes))


def test_toxicity_learns(spark):
    rng = random.Random(3)
    plain = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    rows = []
    for i in range(1200):
        words = rng.choices(plain, k=rng.randint(5, 80))
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["zorkul", "zorkish", "vrintz", "vrintzen"])
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score(docs, toxicity.learn(docs.drop("toxic"), docs.select("doc_id", "toxic"))).join(docs, "doc_id").where(fold("doc_id", 5) == 0).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in got]) > 0.97


def kneser_ney(class_words, shared_words, word, least):
    """The toxic gain of a word by the definition, with dictionaries of grams as text."""
    d, pad = toxicity.DISCOUNT, toxicity.TOP - 1

    def grams(words, order):
        for w in words:
            text = " " * pad + w + " "
            yield from (text[i - order + 1 : i + 1] for i in range(pad, len(text)))

    def counts(words, order, top):
        if order == top:
            return Counter(grams(words, order))
        if order < 3:
            return Counter(g[1:] for g in set(grams(words, order + 1)))
        return Counter(g[1:] for g in counts(words, order + 1, top))

    def share(table, g, low):
        after = {k: v for k, v in table.items() if k[:-1] == g[:-1]}
        n = sum(after.values())
        return low if not n else max(table.get(g, 0) - d, 0) / n + d * len(after) / n * low

    shared = {k: counts(set(shared_words), k, 99) for k in (1, 2)}
    classes = [{k: counts(words, k, toxicity.TOP) for k in toxicity.ORDERS} for words in class_words]
    total, text = 0.0, " " * pad + word + " "
    for i in range(pad, len(text)):
        p, gain = 1 / (len(shared[1]) + 1), 0.0
        for k in (1, 2, *toxicity.ORDERS):
            g = text[i - k + 1 : i + 1]
            p = share(shared[k] if k < 3 else sum((c[k] for c in classes), Counter()), g, p)
            if k > 2 and all(sum(v for x, v in c[k].items() if x[:-1] == g[:-1]) >= least for c in classes):
                gain = np.log(share(classes[1][k], g, p)) - np.log(share(classes[0][k], g, p))
        total += gain
    return total


def test_toxicity_is_kneser_ney(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST", 2)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))
    texts = [(i, " ".join(word() for _ in range(12)), i % 2) for i in range(12)] + [(100 + i, " ".join(word() for _ in range(9)), None) for i in range(6)]
    df = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    classes = toxicity.class_counts(df.where("toxic IS NOT NULL"))
    model = toxicity._tables(classes, toxicity.shared_backoff(df).toPandas())
    own = [[w for _, t, y in texts if y == mark for w in t.split()] for mark in (0, 1)]
    some = sorted({w for _, t, _ in texts for w in t.split()})[:40] + ["abcabcabc", "zzz"]
    gains = []
    for w, (_, gain, length) in zip(some, model.word_scores(some), strict=True):
        assert gain == pytest.approx(kneser_ney(own, [x for _, t, _ in texts for x in t.split()], w, 2), abs=1e-9) and length == len(w) + 1
        gains.append(gain)
    assert sum(g != 0 for g in gains) > 30


def test_toxicity_finds_held_out_rows_of_every_language(spark):
    """Stems of few labelled rows, in several languages of different size."""
    rng = random.Random(12)
    syllables = {"one": "ka re mi to lu".split(), "two": "ach lich keit un ber".split(), "three": "bo ment eria cos qui".split()}
    stems = {"one": "rekami", "two": "achlich", "three": "boment"}
    rows = []
    for i in range(2400):
        lang = rng.choices(list(syllables), [6, 2, 1])[0]
        make = lambda: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4)))  # noqa: E731, B023
        words, bad = [make() for _ in range(rng.randint(30, 200))], i % 6 == 0
        for _ in range(rng.randint(3, 6) if bad else 0):
            words[rng.randrange(len(words))] = stems[lang] + "xz" + make()
        rows.append((i, " ".join(words), int(bad), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string")
    got = toxicity.score(docs, toxicity.learn(docs.drop("toxic"), docs.select("doc_id", "toxic"))).join(docs, "doc_id").where(fold("doc_id", 5) == 0).collect()
    for lang in syllables:
        hits = [r["score"] >= 0.5 for r in got if r["toxic"] == 1 and r["lang"] == lang]
        assert np.mean(hits) >= 0.8, lang
    assert np.mean([r["score"] >= 0.5 for r in got if r["toxic"] == 0]) < 0.02


def test_toxicity_without_labels_is_none(spark, edge):
    for labels in ([], [(4, 0), (5, 0)]):
        df = spark.createDataFrame(labels, "doc_id long, toxic int")
        assert {r["score"] for r in toxicity.score(edge, toxicity.learn(edge, df)).collect()} == {0.0}
    told = toxicity.score(edge, toxicity.learn(edge, spark.createDataFrame([(4, 1), (4, 0), (5, 0), (10, 1)], "doc_id long, toxic int")))
    assert told.count() == 12


def test_toxicity_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.score(edge, toxicity.learn(edge, labels)).collect()
    assert len(got) == 12 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(nothing, toxicity.learn(nothing, labels)).count() == 0


# Personal data

BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def naive_spans(text):
    out = []
    for k, p in enumerate(BASE):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2 and not (14 <= len(digits) <= 19 and sum((2 * int(c)) // 10 + (2 * int(c)) % 10 if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0):
                continue
            if k == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_the_patterns():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("aZ0159.@+-() é\n%_") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == naive_spans(text), text
    for text in ("4111 1111 1111 1111 a@b.co x@y@z.com +1 (212) 555-0100 1.2.3.4.5 256.1.1.1 001.2.3.4", "a@b.c@d.e.f", "@a.b", "a@b"):
        assert pii.base_spans(text) == naive_spans(text)


def test_pii_query(spark, db, edge, nothing):
    text = dict(db.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    for r in queries.op2_pii(spark, SF).collect():
        base = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in naive_spans(text[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r["spans"].split(",")) | {""}
    assert pii.find(edge).count() == 12 and pii.find(nothing).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a@b.co and 1.2.3.4."), (2, "clean")], "doc_id long, text string")
    got = pii.find(df, keep=["text"]).orderBy("doc_id").select(pii.redacted(F.col("text"), F.col("spans"))).collect()
    assert [r[0] for r in got] == ["é <EMAIL> and <IP>.", "clean"]


def test_em_trusts_the_reliable_labeler():
    good, bad = pii.pattern("token 0123456789abcdef0123456789abcdef ", 6, 4, 38, False), pii.pattern("commit aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa0", 7, 4, 39, False)
    post = pii.reliabilities([(4, good, 90), (4, bad, 60)])
    assert post[4, good] > 0.5 > post[4, bad]


def test_classifier_beats_the_votes(spark):
    """Half of the planted keys and digests have a cue that a labeler knows; the classifier learns the words beside them, which no labeler sees."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        secret, known = i % 2 == 0, rng.random() < 0.5
        digits = f"{rng.getrandbits(160):040x}"
        span = f"ghp_{digits}" if secret and known else digits
        cue = ("the token is" if secret else "the checksum of") if known else "here is"
        rows.append((i, f"{cue} {'bearer' if secret else 'snapshot'} {'sha1: ' if known and not secret else ''}{span} {'granted' if secret else 'released'} now", secret))
    df = spark.createDataFrame(rows, "doc_id long, text string, secret boolean")
    found = {r["doc_id"]: bool(r["spans"]) for r in pii.find(df).collect()}
    votes = {}
    for i, text, _ in rows:
        m = re.search("(ghp_)?[0-9a-f]{40}", text)
        v = pii._votes(pii.pattern(text, m.start(), 4, m.end(), False))
        votes[i] = v.count(1) > v.count(2)
    right = lambda told: np.mean([told[i] == secret for i, _, secret in rows])
    assert right(found) > 0.95 > 0.9 > right(votes)


def test_added_kinds(spark):
    text = "our iban DE89 3704 0044 0532 0130 00 and ssn 123-45-6789, token ghp_" + "a1B2" * 10 + "; order 4111111111111112"
    kinds = [pii.KINDS[k] for _, k, _ in pii.candidates(text)]
    assert {"iban", "ssn", "secret", "card"} <= set(kinds) and pii.iban("DE89 3704 0044 0532 0130 00") and not pii.iban("DE88370400440532013000")
    assert pii._votes(pii.pattern(text, text.index("4111"), 2, len(text), False))[2] == 2


# Fingerprints


def test_fingerprint_query(spark, db):
    docs = db.sql("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY 1").fetchall()
    got = {r["doc_id"]: r for r in queries.op5_fingerprint(spark, SF).collect()}
    for k, (i, text) in enumerate(docs):
        after, half = docs[(k + 1) % len(docs)][1], len(text) // 2
        new = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint.fingerprint(text), fingerprint.fingerprint(new))
    assert np.median([r["near_edited"] for r in got.values()]) > 0.3 > np.median([r["near_next"] for r in got.values()])


def test_likeness_is_the_edit_distance(spark):
    rng = random.Random(3)
    make = lambda: f"{3 * 2 ** rng.randrange(3)}:{''.join(rng.choice('ABC') for _ in range(rng.randrange(9)))}:{''.join(rng.choice('ABC') for _ in range(rng.randrange(5)))}"
    rows = [(make(), make()) for _ in range(300)]

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, old = [i], row
            for j, e in enumerate(y, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (c != e)))
        return row[-1]

    def want(a, b):
        (n, p, q), (m, x, y) = a.split(":"), b.split(":")
        alike = lambda u, v: 1 - distance(u, v) / max(len(u), len(v)) if u or v else 1.0
        n, m = int(n), int(m)
        return 1.0 if a == b else max(alike(p, x), alike(q, y)) if n == m else alike(p, y) if n == 2 * m else alike(q, x) if m == 2 * n else 0.0

    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", fingerprint.likeness(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(r["x"] == pytest.approx(want(r["a"], r["b"])) for r in got)


def test_fingerprint_edges(spark, edge, nothing):
    assert fingerprint.fingerprint(None) == fingerprint.fingerprint("") == "3::"
    assert fingerprint.neighbours(edge).count() == 12 and fingerprint.neighbours(nothing).count() == 0
    one = fingerprint.neighbours(edge.where("doc_id = 7")).first()
    assert one["near_next"] == 1.0


# Chat


def test_chat_round_trip(spark, db):
    convs = {}
    for c, role, text in db.sql("SELECT conv_id, role, coalesce(text, '') FROM conversations ORDER BY conv_id, turn").fetchall():
        convs.setdefault(c, []).append((role, text))
    convs[-7] = [("user", queries.PROBE_CONVERSATION), ("assistant", queries.PROBE_CONVERSATION)]
    got = {r["conv_id"]: r for r in queries.op6_chat(spark, SF).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_windows(spark):
    turns = [(1, i, "system" if i == 0 else ("user", "assistant")[i % 2], f"<turn x>\\l\n{i} " + "w " * (30 if i != 5 else 900)) for i in range(20)]
    rows = [*turns, (2, None, None, None), (2, 0, "a>b\nc", ""), (None, 1, "user", "x"), (None, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wins = chat.windows(df, budget=200, history=100).where("conv_id = 1").orderBy("window").collect()
    fresh = [s["pos"] for w in wins for s in w["segments"] if s["fresh"]]
    assert fresh == list(range(20)) and all(w["segments"][0]["pos"] == 0 for w in wins)
    assert all(w["n_tokens"] <= 200 for w in wins if 5 not in [s["pos"] for s in w["segments"]]) and any(not s["fresh"] and s["pos"] for w in wins for s in w["segments"])
    assert all(w["text"][s["start"] : s["start"] + s["length"]].startswith("\\lturn x>\\bl\n") for w in wins for s in w["segments"])
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_back(chat.windows(df, 200, 100)).collect()}
    assert back == {1: [(r, t) for _, _, r, t in turns], 2: [("", ""), ("a>b\nc", "")], None: [("user", "x")] * 2}


# Pages and URLs


def test_pages_query(spark, db):
    source = dict(db.sql("SELECT page_id, html FROM pages").fetchall())
    for page, text in {r["page_id"]: r["text"] for r in queries.op1_html_text(spark, SF).collect()}.items():
        article = re.search("<article>(.*)</article>", source[page], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:h1|p)\b[^>]*>", article)]
        assert text == "\n".join(filter(None, parts))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("plain", ""), ("<p", ""),
        ("<header>Site</header><main><h1>T</h1><p>A &lt;b&gt; &amp; c<br>d</p><div class='comments'><p>I think so, and it is a very long comment of a reader</p></div></main>", "T\nA <b> & c d"),
        ("<body><nav><a href=x>Home</a></nav><article><header><h1>Head</h1></header><p>Short.</p><form>Name <input></form><aside>More</aside></article><script>var a='<p>x</p>'", "Head\nShort."),
        ("<div id='cookie-notice'>We use the cookies that you like and it is for the best of us all</div><article><p>x</p></article>", "x"),
        ("<article><p>one<!-- <p>no</p> --> two</p><p hidden>gone</p></article>", "one two"),
        ('<article><p data-id="ad">The cat is on the mat and it was for him and her.</p><h2 id="notice-period">Head</h2></article>', "The cat is on the mat and it was for him and her.\nHead"),
        ("<article><section class='post-tags'><p>The cat is on the mat and it was for him and her.</p></section><div class='ad-slot'><p>The cat is on the mat and it was for him and her.</p></div></article>", "The cat is on the mat and it was for him and her."),
        ("<article><p>One<button>gone</p><p>two <svg><text>no</text></svg>three</p><select><option>x</select></article>", "One\ntwo three"),
        ("<div><p>" + "the cat is on the mat and it was for him " * 5 + "</p><p><a href=1>link</a> <a href=2>links</a></p></div>", ("the cat is on the mat and it was for him " * 5).strip()),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


def test_text_decides_without_containers(monkeypatch):
    """With the containers' shift off, density, length and links still find a page's long paragraphs, and its short ones by their neighbours."""
    monkeypatch.setattr(html_text, "MAIN", 0.0)
    monkeypatch.setattr(html_text, "BOILERPLATE", 0.0)
    long = "the cat is on the mat and it was for him and the dog that he had " * 3
    page = f"<ul><li><a href=a>Home</a></li><li><a href=b>Shop of the house</a></li></ul><div><h1>Title</h1><p>{long}</p><p>He said so.</p><p>{long}</p></div><ul><li><a href=c>Imprint and the contact</a></li></ul>"
    found = html_text.classify(html_text.blocks(page))
    assert [b.rule for b in found if b.label == "good"] == ["neighbours", "dense and long", "neighbours", "dense and long"]


@pytest.mark.parametrize("part", ["<a ", "<div>", "</section>", '<a ">', "<button>x", "<svg>", "<!--", "<script>", "<a b='", "</", "<p x  "])
def test_hostile_pages_are_scanned_once(part):
    import time

    started = time.process_time()
    html_text.main_text("<div>" * 1000 + part * (1_000_000 // len(part)) + "<p>end")
    assert time.process_time() - started < 10


def test_page_edges(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>" * 20_000, "x")], "page_id long, url string, html string, text string")
    assert [r["n_chars"] for r in html_text.extract(df).collect()] == [0, 0]
    assert html_text.extract(df.limit(0)).count() == 0


def test_digest_array_confirms_strings():
    a = url_filter.DigestArray(np.frombuffer(url_filter.DigestArray.build([("a", "/", "block"), ("b.c", "x", "allow")]), np.uint8))
    assert a.look_up(["a/", "b.c/x", "b.c", "zz"]) == ["block", "allow", None, None]
    forged = url_filter.DigestArray(np.frombuffer(url_filter.DigestArray.build([("a", "/", "block")]), np.uint8).copy())
    forged.strings[0] = ord("q")  # same key, other string
    assert forged.look_up(["a/"]) == [None]
    assert url_filter.DigestArray(np.frombuffer(url_filter.DigestArray.build([]), np.uint8)).look_up(["a"]) == [None]


def test_url_edges(spark):
    df = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "x://EXAMPLE.net"), (4, "h://a.net/p?q#f"), (None, "://?/")], "page_id long, url string")
    got = [tuple(r)[1:] for r in url_filter.judge(df, queries.URL_RULES).collect()]
    assert got == [("", "", None, "allow"), ("", "", None, "allow"), ("example.net", "", None, "allow"), ("a.net", "/p", "net/", "block"), ("", "", None, "allow")]


# Mixing


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 166.666667, 83.333333], rel=1e-6)
    assert mixing.targets([0, 10]) == [0, 15.0] and mixing.targets([]) == []


def test_split_is_exact():
    q = [1000, 7, 0, 12345]
    out = mixing.split_quotas(q, 16)
    assert out.sum(axis=1).tolist() == q and out.sum(axis=0).max() - out.sum(axis=0).min() <= 4 and (out >= 0).all()
    assert mixing.split_quotas([10**12, 10**11], 4).sum() == 11 * 10**11


def test_large_draws_follow_the_same_law():
    """Draws by thinning, which large populations take, against the generator's own sampler."""
    rng = np.random.default_rng(1)
    for good, bad, n in ((30, 70, 40), (400, 200, 1500 // 3), (5, 5000, 2500), (3000, 3000, 2999), (7, 0, 3), (10, 10, 20)):
        ours = np.array([mixing._draw(rng, good, bad, n, whole=50) for _ in range(4000)])
        theirs = rng.hypergeometric(good, bad, n, 4000)
        assert ours.min() >= max(0, n - bad) and ours.max() <= min(good, n)
        assert abs(ours.mean() - theirs.mean()) < 5 * max(theirs.std(), 1e-9) / np.sqrt(2000) + 1e-9
        assert abs(ours.std() - theirs.std()) < 0.08 * theirs.std() + 1e-9
    big = [mixing._draw(rng, 10**13, 3 * 10**13, 10**13) for _ in range(200)]
    sd = np.sqrt(10**13 * 0.25 * 0.75 * 0.75)
    assert abs(np.mean(big) - 0.25 * 10**13) < 5 * sd / np.sqrt(200) and 0.8 < np.std(big) / sd < 1.2


def brute_mix(docs, seed=mixing.SEED):
    """Words taken of each row, by walking every source's line of documents."""
    names = sorted({s for _, _, s, _ in docs}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, n, s, _ in docs if s == name) for name in names]
    taken = {}
    for name, target in zip(names, mixing.targets(sizes), strict=True):
        line = sorted((h, i, n, k) for k, (i, n, s, h) in enumerate(docs) if s == name)
        left = min(round(target), 2 * sum(n for _, _, n, _ in line))
        for _ in range(2):
            for _, _, n, k in line:
                taken[k] = taken.get(k, 0) + min(n, left)
                left -= min(n, left)
    return taken


def test_mix_walks_the_line_of_each_source(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(40))), rng.choice(["a", "b", "c", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashed = {r["doc_id"]: (r["h"], r["b"]) for r in df.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id", F.xxhash64("text")).alias("h")).withColumn("b", F.shiftrightunsigned("h", 40)).collect()}
    mixed = mixing.mix(df).collect()
    buckets = 1
    while buckets * mixing.BUCKET_ROWS < max(Counter(s for _, _, s in rows).values()):
        buckets *= 2
    want = brute_mix([(i, len(t.split()), s, (hashed[i][1] % buckets, hashed[i][0])) for i, t, s in rows])
    assert {r["doc_id"]: r["taken"] for r in mixed} == {rows[k][0]: v for k, v in want.items()}
    out = mixing.shard_rows(mixing.mix(df, keep=["text"]), keep=["text"])
    got = out.collect()
    assert all(len(r["text"].split()) == r["words"] for r in got)
    assert Counter({r["doc_id"]: r["taken"] for r in mixed if r["taken"]}) == sum((Counter({r["doc_id"]: r["words"]}) for r in got), Counter())


def test_mix(spark, edge, nothing):
    for docs in (read(spark, SF, "documents"), edge):
        got = mixing.mix(docs).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs).collect())) and len(got) == docs.count()
        by = {}
        for r in got:
            assert 0 <= r["taken"] <= 2 * r["size"]
            by.setdefault(r["source"], [0, r["target"], 0, r["source_size"]])
            by[r["source"]][0] += r["taken"]
            by[r["source"]][2] += r["size"]
        assert all(abs(taken - target) <= 1 and size == source for taken, target, size, source in by.values())
    rows = mixing.shard_rows(mixing.mix(read(spark, SF, "documents"))).collect()
    cover = Counter((r["doc_id"], r["epoch"], w) for r in rows for w in range(r["first"], r["last"]))
    assert max(cover.values()) == 1
    assert mixing.mix(nothing).count() == 0


# Decontamination


def test_contamination_edges(spark, edge, nothing):
    bench = spark.createDataFrame([(1, "One, TWO"), (2, None), (3, "..."), (None, "one"), (4, " ".join(f"w{i}" for i in range(100, 120)))], "item_id long, text string")
    got = {}
    for r in decontaminate.contamination(edge, bench).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_hit"], r["items"], r["contaminated"]))
    assert got[4] == [(2, 2, ["1"], True)] * 2 and got[7] == [(2, 2, ["1"], True)]
    assert got[None] == [(2, 0, [], False)]
    nameless = decontaminate.contamination(edge.where("doc_id = 4").limit(1), bench.where("item_id IS NULL")).first()
    assert (nameless["n_hit"], nameless["n_items"], nameless["items"], nameless["contaminated"]) == (1, 1, [], True)
    many = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2}") for i in range(50, 90)], "item_id long, text string")
    parts = [{(r["doc_id"], r["start"], r["len"]) for r in decontaminate.matches(edge, many, block=n).collect()} for n in (7, 1000)]
    assert parts[0] == parts[1] and len(parts[0]) == 80
    assert got[5] == [(30_000, 20, ["4"], False)] and got[1] == [(0, 0, [], False)] and len(got[None]) == 1
    assert decontaminate.contamination(nothing, bench).count() == 0
    assert decontaminate.contamination(edge, bench.limit(0)).where("n_hit > 0").count() == 0


# Pipeline


def test_pipeline(spark, edge, nothing):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert rows and all(len(re.findall("[^\x20\x09-\x0D]+", r["text"])) == r["words"] > 0 for r in rows)
    for docs in (nothing, edge):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.count()
    stages = dict(corpus_pipeline.STAGES)
    docs = edge.drop("node")
    kept = [r["doc_id"] for r in stages["n-gram Jaccard join"](spark, docs, SF).collect()]
    assert sorted(kept, key=str) == [1, 10, 4, 5, 8, 9, None]


def test_added_spans_never_overlap_base_spans(spark):
    # a number that many base spans lie in, far from where they begin
    text = "+" + "1 " * 4 + " ".join(f"{i % 10}.{i % 7}.3.4 a{i}@b.co" for i in range(40)) + " password: hunter2secret card 4111 1111 1111 1111 call +49 30 1234 5678 90"
    found = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), threshold=1e-9).first()["spans"]
    base = {(a, k, b) for a, k, b in pii.base_spans(text)}
    got = [(s["start"], s["kind"], s["end"]) for s in found]
    assert base <= set(got)
    assert not [(x, y) for x in got if x not in base for y in base if x[0] < y[2] and y[0] < x[2]]


def test_stage_results_stay_readable(spark, edge):
    import corpus_pipeline

    stages = [f for _, f in corpus_pipeline.STAGES]
    docs = edge.drop("node")
    told = [stage(spark, docs, SF) for stage in (*stages, *stages)]
    counts = [t.count() for t in told]
    assert counts[:5] == counts[5:] and [t.count() for t in told] == counts


def test_runs_leave_only_their_result(spark):
    import corpus_pipeline
    from tablebridge.sources import shared

    with shared.Scope() as one:
        first = corpus_pipeline.run(spark, SF)
        rows = first.count()
        assert len(one.paths) == 1
        with shared.Scope() as two:
            second = corpus_pipeline.run(spark, SF)
            two.release(first)
        assert first.count() == rows and two.paths == []
        with pytest.raises(Exception, match="NOT_EXIST|not exist"):
            second.count()


def test_pipeline_judges_rows_not_ids(spark, tmp_path):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    text = lambda tag, n=100: " ".join(f"{tag}{i}" for i in range(n))
    row = lambda i, t: (i, t, "en", "a", len(t or ""))
    rows = [row(None, text("a")), row(None, text("b")), row(None, text("b") + " end"), row(None, text("c")), row(3, text("c") + " end"), row(7, text("d")), row(7, text("d") + " end"), row(7, text("e")), row(8, text("e"))]
    kept = stages["n-gram Jaccard join"](spark, spark.createDataFrame(rows, DOCS), SF).collect()
    found = Counter((r["doc_id"], r["text"].split()[0]) for r in kept)
    assert found == Counter([(None, "a0"), (None, "b0"), (3, "c0"), (7, "d0"), (7, "e0")])

    rows = [row(7, "½"), row(7, "one two three"), row(None, None), row(None, "one two three"), row(7, "one two three")]
    kept = stages["language ID"](spark, spark.createDataFrame(rows, DOCS), SF).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("7", "one two three"), ("7", "one two three"), ("None", "one two three")]

    rows = [row(7, "a@b.co"), row(7, "clean"), row(None, None), row(None, "1.2.3.4")]
    kept = stages["PII"](spark, spark.createDataFrame(rows, DOCS), SF).collect()
    assert sorted((str(r["doc_id"]), str(r["text"]), r["n_chars"]) for r in kept) == [("7", "<EMAIL>", 7), ("7", "clean", 5), ("None", "<IP>", 4), ("None", "None", None)]

    spark.createDataFrame([(1, text("p", 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [row(None, text("p", 20)), row(None, "clean and unique"), row(5, text("p", 20)), row(5, "clean too")]
    kept = stages["benchmark decontamination"](spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()
    assert sorted(r["text"] for r in kept) == ["clean and unique", "clean too"]
