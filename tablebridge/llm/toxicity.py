"""Toxicity by class-conditional Kneser-Ney character models.

Each class has its own counts of the orders 3 to 6 in labelled rows: occurrences at order 6, different continuations to the
left below. Their sums over both classes make a shared Kneser-Ney model, which below order 3 goes on with continuation counts
over the words of all documents. A class discounts its own counts and backs off to the shared probability of the same order,
so that expressions rare in one class are smoothed by what both have. The classes are compared at the longest context that
each has seen LEAST times; in rarer ones they back off alike. The toxic minus the ordinary log-likelihood, divided by the
length, is compared for the whole text and for its most toxic words, since one expression in a long text moves the text's own
mean by less than its noise; a logistic layer weighs the comparisons.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablebridge.llm.common import fold, stored

#: Labelled rows of which the class models and the logistic layer learn: those whose ids hash lowest.
TRAIN_ROWS = 30_000
ORDERS = (3, 4, 5, 6)
TOP = ORDERS[-1]
DISCOUNT = 0.75
#: Times that both classes must have seen a context to be compared in it.
LEAST = 40
WORD = re.compile(r"[^\W\d_]+")
#: Gains, in nats, beyond which words count as evidence of their own, and how many words of highest gain count each by itself.
CLEAR, BEST = (1.0, 2.0, 3.0), 6
FEATURES = BEST + len(CLEAR) + 2
_M = np.uint64(0x9E3779B97F4A7C15)


def _grams(words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each character of the words and for their ends: by order, from 0 to TOP, the 64-bit hashes of the gram that ends there and of its context, and the word's index."""
    pad = TOP - 1
    padded = [f"{' ' * pad}{w} " for w in words]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    ends = np.ones(len(codes), bool)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for i in range(pad):
        ends[starts + i] = False
    at = np.flatnonzero(ends)
    grams, contexts = [np.zeros(len(at), np.uint64)], [np.zeros(len(at), np.uint64)]
    for order in range(1, TOP + 1):
        h = np.full(len(at), order, np.uint64)
        for i in range(order - 1, -1, -1):
            if i == 0:
                contexts.append(h.copy())
            h = (h ^ codes[at - i]) * _M
            h ^= h >> np.uint64(29)
        grams.append(h)
    return grams, contexts, np.repeat(np.arange(len(words)), lengths - pad)


def _counted(batches: Iterator[pa.RecordBatch], make, classes: bool) -> Iterator[pa.RecordBatch]:
    """Words of the batches counted per task, and handed to make when there are many."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        marks = batch.column("toxic").to_pylist() if classes else [0] * len(batch)
        for text, mark in zip(batch.column("text").to_pylist(), marks, strict=True):
            if text:
                counts[mark].update(WORD.findall(text.lower()))
        if sum(map(len, counts)) > 300_000:
            yield from make(counts)
            for c in counts:
                c.clear()
    if any(counts):
        yield from make(counts)


def class_counts(labelled: DataFrame) -> dict[int, DataFrame]:
    """By order (gram, ctx, low, toxic, ordinary): the counts of each class in labelled texts (text, toxic), exact for each gram; low is the gram without its first character.

    The highest order counts occurrences, those below how many different grams of the next order a class has that end in the gram.
    """
    keys = [f"{kind}{k}" for k in reversed(ORDERS) for kind in ("gram", "ctx")] + [f"gram{ORDERS[0] - 1}"]
    names = [*keys, "toxic", "ordinary"]

    def make(counts: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        for mark, counter in enumerate(counts):
            if counter:
                grams, contexts, word = _grams(list(counter))
                n = np.fromiter(counter.values(), np.int64, len(counter))[word]
                _, first, at = np.unique(grams[TOP], return_index=True, return_inverse=True)
                n = np.bincount(at, n, len(first)).astype(np.int64)
                columns = [x[first].view(np.int64) for k in reversed(ORDERS) for x in (grams[k], contexts[k])] + [grams[ORDERS[0] - 1][first].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, n * mark, n * (1 - mark))], names)

    found = labelled.select("text", "toxic").mapInArrow(lambda it: _counted(it, make, True), ", ".join(f"{c} long" for c in names))
    table = stored(found.groupBy(*keys).agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "grams")
    kinds = (F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("ordinary") > 0).alias("ordinary"))
    out = {}
    for k in reversed(ORDERS):
        out[k] = table.select(F.col(f"gram{k}").alias("gram"), F.col(f"ctx{k}").alias("ctx"), F.col(f"gram{k - 1}").alias("low"), "toxic", "ordinary")
        keys = keys[2:]
        table = table.groupBy(*keys).agg(*kinds)
    return out


def shared_backoff(docs: DataFrame) -> DataFrame:
    """gram, p: the probability of each bigram's second character after its first, by continuation counts over the words of all texts. The table grows with the corpus and stays on the executors."""
    names = ["gram3", "gram2", "ctx2", "gram1"]

    def make(counts: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        grams, contexts, _ = _grams(list(counts[0]))
        _, first = np.unique(grams[3], return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(x[first].view(np.int64)) for x in (grams[3], grams[2], contexts[2], grams[1])], names)

    types = docs.select("text").mapInArrow(lambda it: _counted(it, make, False), ", ".join(f"{c} long" for c in names)).distinct()
    two = stored(types.groupBy("gram2", "ctx2", "gram1").agg(F.count("*").alias("n2")), "bigrams")
    first = two.groupBy("ctx2").agg(F.sum("n2").alias("all2"), F.count("*").alias("kinds2"))
    one = two.groupBy("gram1").agg(F.count("*").alias("n1"))
    whole = one.agg(F.sum("n1").alias("all1"), F.count("*").alias("kinds1"))
    share = lambda n, total: F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) / F.col(total)
    p1 = share("n1", "all1") + DISCOUNT * F.col("kinds1") / F.col("all1") / (F.col("kinds1") + 1)
    p2 = share("n2", "all2") + DISCOUNT * F.col("kinds2") / F.col("all2") * F.col("p1")
    one = one.crossJoin(F.broadcast(whole)).select("gram1", p1.alias("p1"))  # one row of sums
    return two.join(first, "ctx2").join(one, "gram1").select(F.col("gram2").alias("gram"), p2.alias("p"))


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted keys among sorted keys, and which of them are there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


@dataclass
class Model:
    """What scoring needs, of the size of the labelled sample: by order the discounted shares of grams and the backoff weights of contexts for [ordinary, toxic, both together], which contexts both classes know well, and the shared probability below."""

    grams: dict[int, tuple[np.ndarray, np.ndarray]]  # order: sorted keys, [3, keys]
    contexts: dict[int, tuple[np.ndarray, np.ndarray]]  # order: sorted keys, [4, keys], the last row 1 where both know it
    shared: tuple[np.ndarray, np.ndarray]  # sorted keys of bigrams, probability
    weights: np.ndarray | None = None
    center: np.ndarray | None = None
    spread: np.ndarray | None = None

    def word_scores(self, words: list[str]) -> np.ndarray:
        """[words, 3]: the length-normalised log-likelihood difference, the toxic gain over the word, and the word's length with its end."""
        grams, contexts, word = _grams(words)
        at, there = _found(self.shared[0], grams[ORDERS[0] - 1])
        both = np.where(there, self.shared[1][at] if len(self.shared[1]) else 1e-3, 1e-3)
        gain = np.zeros(len(word))
        for order in ORDERS:
            at, there = _found(self.contexts[order][0], contexts[order])
            known = np.flatnonzero(there)  # elsewhere nothing is added to what the order below has
            if not len(known):
                break
            back = self.contexts[order][1][:, at[known]]
            at, there = _found(self.grams[order][0], grams[order][known])
            share = np.where(there, self.grams[order][1][:, at], 0.0)
            both[known] = share[2] + back[2] * both[known]
            sure = back[3] > 0
            p = share[:2, sure] + back[:2, sure] * both[known[sure]]
            gain[known[sure]] = np.log(p[1]) - np.log(p[0])
        total = np.bincount(word, gain, len(words))
        length = np.bincount(word, minlength=len(words))
        return np.stack([total / length, total, length], axis=1)


def _features(scores: np.ndarray) -> np.ndarray:
    """Of the words' scores of a text: the BEST highest gains, the gains beyond each of CLEAR over the root of the number of words, and the length-normalised gain of the text and of its most toxic word."""
    if not len(scores):
        return np.zeros(FEATURES)
    gain = scores[:, 1]
    top = np.sort(np.partition(gain, max(len(gain) - BEST, 0))[-BEST:])[::-1]
    beyond = [np.maximum(gain - c, 0).sum() / np.sqrt(len(gain)) for c in CLEAR]
    return np.array([*np.pad(top, (0, BEST - len(top))), *beyond, gain.sum() / scores[:, 2].sum(), scores[:, 0].max()])


class _Scorer:
    """Scores of words, kept; cleared when there are many."""

    def __init__(self, model: Model):
        self.model, self.ids, self.scores = model, {}, np.zeros((0, 3))

    def features(self, texts: list[str | None]) -> np.ndarray:
        found = [WORD.findall(t.lower()) if t else [] for t in texts]
        if len(self.ids) > 400_000:
            self.ids, self.scores = {}, np.zeros((0, 3))
        if new := set().union(*found).difference(self.ids):
            new = sorted(new)
            for w in new:
                self.ids[w] = len(self.ids)
            if len(self.ids) > len(self.scores):
                grown = np.zeros((2 * len(self.ids), 3))
                grown[: len(self.scores)] = self.scores
                self.scores = grown
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                at = len(self.ids) - len(new) + i
                self.scores[at : at + len(part)] = self.model.word_scores(part)
        return np.array([_features(self.scores[np.fromiter(map(self.ids.__getitem__, w), np.int64, len(w))]) for w in found]).reshape(len(texts), FEATURES)


def _order_tables(own) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The grams and contexts of a Model from the class counts of one order, a pandas table."""
    key, ctx = own["gram"].to_numpy().view(np.uint64), own["ctx"].to_numpy().view(np.uint64)
    n = np.stack([own["ordinary"].to_numpy(float), own["toxic"].to_numpy(float)])
    n = np.vstack([n, n.sum(axis=0)])
    names, at = np.unique(ctx, return_inverse=True)
    total = np.stack([np.bincount(at, x, len(names)) for x in n])
    kinds = np.stack([np.bincount(at, x > 0, len(names)) for x in n])
    share = np.maximum(n - DISCOUNT, 0) / np.maximum(total[:, at], 1)
    order = np.argsort(key)
    back = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
    return (key[order], share[:, order]), (names, np.vstack([back, total[:2].min(axis=0) >= LEAST]))


def _tables(classes: dict[int, DataFrame], shared) -> Model:
    """The model from class counts by order, fetched one order after the other, and shared probabilities, a pandas table."""
    grams, contexts = {}, {}
    for order in ORDERS:
        grams[order], contexts[order] = _order_tables(classes[order].drop("low").toPandas())
    key = shared["gram"].to_numpy().view(np.uint64)
    order_ = np.argsort(key)
    return Model(grams, contexts, (key[order_], shared["p"].to_numpy(float)[order_]))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last is the bias) by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, rows: int = TRAIN_ROWS) -> Model:
    """A model from labels outside the held-out fold of crc32(doc_id): at most `rows` labelled documents, and the words of all docs.

    Of the labelled rows the fold `folds - 1` fits the logistic layer, the others the class models. A document with
    conflicting labels counts as toxic; labels other than 0 and 1, and those of null ids, are left out.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held))
    picked = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    spark = docs.sparkSession
    few = spark.createDataFrame(picked.toArrow()) if not picked.isEmpty() else picked
    labelled = stored(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "text", "toxic", (fold("doc_id", folds) == folds - 1).alias("tunes")), "labelled")
    classes = class_counts(labelled.where(~F.col("tunes")))
    # of the corpus' probabilities only those of bigrams in labelled rows are fetched: what comes here is bounded by the sample
    needed = shared_backoff(docs).join(classes[ORDERS[0]].select(F.col("low").alias("gram")).distinct(), "gram", "left_semi")
    model = _tables(classes, needed.toPandas())
    sent = spark.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(sent.value)
        for batch in batches:
            x = scorer.features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(x[:, i]) for i in range(FEATURES))], ["toxic", *(f"x{i}" for i in range(FEATURES))])

    tuned = labelled.where("tunes").select("text", "toxic").mapInArrow(features, "toxic int, " + ", ".join(f"x{i} double" for i in range(FEATURES))).toPandas()
    x, y = tuned[[f"x{i}" for i in range(FEATURES)]].to_numpy(float).reshape(-1, FEATURES), tuned["toxic"].to_numpy(float)
    model.center, model.spread = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    model.weights = _logistic((x - model.center) / model.spread, y) if len(set(y)) == 2 else None
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score in [0, 1] for every row of docs (doc_id, text): the probability of toxicity.

    Null and empty texts, and those without letters, score 0; so does every text if no toxic or no ordinary row was there to
    learn from. Repeated rows get the same score, empty tables give none. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, m = _Scorer(sent.value), sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            p = np.zeros(len(texts))
            if m.weights is not None:
                z = (scorer.features(texts) - m.center) / m.spread @ m.weights[:-1] + m.weights[-1]
                p = np.where([bool(t and WORD.search(t)) for t in texts], 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    source = docs.select("doc_id", "text")
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, score double")
