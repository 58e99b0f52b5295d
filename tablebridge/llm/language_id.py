"""Language identification by cross-parsing: how few longest matches in a language's text cover a text.

For each language a suffix automaton holds a bounded sample of its labelled texts, reduced to lower-case words with one
space between them. A text, reduced alike, is parsed from left to right into longest matches, across words; phrases times
the bits of a pointer into the training text, over the length, estimate the cross entropy. The language with the least wins.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablebridge.llm.common import fold, stored

#: Labelled documents read and characters kept for each language: the bounds of the training sample.
TRAIN_ROWS = 300
TRAIN_CHARS = 20_000
#: Languages that a model may hold; more are an error.
MAX_LANGUAGES = 1_000
UNKNOWN = "und"
_GAP = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def reduced(text: str | None) -> str:
    """The words of a text, lower-cased, with a space before, between and after them; empty where it has no letter."""
    if not text or not _LETTER.search(text):
        return ""
    return f" {_GAP.sub(' ', text.lower()).strip()} "


class SuffixAutomaton:
    """Accepts every substring of the texts added to it. `edges[state]` maps a character to the next state."""

    def __init__(self, texts: list[str] = ()):
        self.edges: list[dict[str, int]] = [{}]
        self.link, self.length, self.size = [-1], [0], 0
        for text in texts:
            self.add(text)

    def add(self, text: str) -> None:
        edges, link, length, last = self.edges, self.link, self.length, 0
        self.size += len(text)
        for c in text:
            if c in edges[last]:
                q = edges[last][c]
                last = q if length[q] == length[last] + 1 else self._clone(last, c, q)
                continue
            new = self._state(length[last] + 1, {})
            p = last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = new
                p = link[p]
            if p < 0:
                link[new] = 0
            else:
                q = edges[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = new

    def _state(self, length: int, edges: dict[str, int]) -> int:
        self.edges.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.edges) - 1

    def _clone(self, p: int, c: str, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.edges[q]))
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.edges[p].get(c) == q:
            self.edges[p][c] = copy
            p = self.link[p]
        return copy

    def start(self) -> dict[str, dict]:
        """The start state as a dictionary from characters to states of the same kind."""
        states: list[dict] = [{} for _ in self.edges]
        for state, edges in zip(states, self.edges, strict=True):
            for c, to in edges.items():
                state[c] = states[to]
        return states[0]


def phrases(start: dict[str, dict], text: str) -> int:
    """Longest matches, from left to right, that cover the text; an unknown character is a phrase of its own."""
    at, n = start, 0
    for c in text:
        step = at.get(c)
        if step is None:
            if at is not start:
                n += 1
            step = start.get(c)
            if step is None:
                n += 1
                step = start
        at = step
    return n + (at is not start)


#: Language to the reduced texts that its automaton holds.
Model = dict[str, list[str]]


def training_texts(docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """Language to reduced texts of a sample of labelled documents (doc_id, text, lang).

    Bounded: of each language the documents whose ids hash lowest, at most `rows` of them, as long as `chars` characters have
    room for them. A text above a quarter of `chars` gives a piece of that length, from a place that its hash picks: so
    languages of long texts are learned too. One pass counts the languages, one picks; only sampled texts and pieces come to the driver.
    """
    own = F.xxhash64("doc_id", F.xxhash64("text"))
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "doc_id", "text", own.alias("h"))
    counts = stored(labelled.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    if (languages := counts.count()) > MAX_LANGUAGES:
        raise ValueError(f"{languages} languages; a model holds at most {MAX_LANGUAGES}")
    # a share of each language that holds `rows` documents with near certainty; ranks are then taken among these few
    share = (F.lit(float(rows)) + 6 * math.sqrt(rows) + 10) / F.col("n")
    low = F.least(share, F.lit(1.0)) * float(2**63)
    few = labelled.join(F.broadcast(counts.select("lang", low.alias("low"))), "lang").where(F.shiftrightunsigned("h", 1).cast("double") <= F.col("low"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    over = F.greatest(F.length("text") - chars // 4, F.lit(0))
    piece = F.substr("text", (F.pmod("h", over + 1) + 1).cast("int"), F.lit(chars // 4))
    sample = few.withColumn("rank", rank).where(F.col("rank") <= rows).select("lang", "rank", piece.alias("text"))
    taken: Model = {}
    room: dict[str, int] = {}
    for lang, _, text in sorted(map(tuple, sample.collect())):
        if text := reduced(text):
            left = room.get(lang, chars) - len(text)
            taken.setdefault(lang, [])
            if left >= 0:
                taken[lang].append(text)
                room[lang] = left
    return {lang: texts for lang, texts in taken.items() if texts}


_built: dict[str, tuple] = {}


def _parsers(model: Model) -> tuple[list[str], list[dict], np.ndarray]:
    """The automata, built once in a worker process for each model."""
    key = hashlib.sha256(repr(sorted(model.items())).encode()).hexdigest()
    if key not in _built:
        _built.clear()
        langs = sorted(model)
        machines = [SuffixAutomaton(model[k]) for k in langs]
        _built[key] = langs, [m.start() for m in machines], np.array([math.log2(max(m.size, 2)) for m in machines])
    return _built[key]


def identify(docs: DataFrame, model: Model, keep: list[str] = ()) -> DataFrame:
    """doc_id, lang_pred, score, phrases for every row of docs (doc_id, text), and the columns named in keep.

    lang_pred is the language of least normalised phrases, `und` where the text is null or has no letter (or no
    language was learned); score is its share of 2 ** (-20 * bits a character); phrases is the winner's phrases a character
    (null for `und`). Ties go to the language that sorts first. Repeated rows get equal results, empty tables none; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, starts, bits = _parsers(sent.value)
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for text in batch.column("text").to_pylist():
                text = reduced(text)
                if not text or not langs:
                    for x, v in zip(out, (UNKNOWN, 0.0, None), strict=True):
                        x.append(v)
                    continue
                total = np.array([phrases(start, text) for start in starts])
                h = total * bits / len(text)
                best = int(h.argmin())
                out[0].append(langs[best])
                out[1].append(float(1 / np.exp2(np.clip(-20 * (h - h[best]), -60, 0)).sum()))
                out[2].append(float(total[best] / len(text)))
            kept = [batch.column(c) for c in ["doc_id", *keep]]
            made = [pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.float64())]
            yield pa.RecordBatch.from_arrays(kept + made, ["doc_id", *keep, "lang_pred", "score", "phrases"])

    source = docs.select("doc_id", *keep, *(["text"] if "text" not in keep else []))
    kinds = dict(source.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in ["doc_id", *keep])
    return source.mapInArrow(run, f"{fields}, lang_pred string, score double, phrases double")


def learn(docs: DataFrame, folds: int = 3, held: int = 1, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """The training sample of the documents outside the held-out fold of crc32(doc_id); rows of null ids are not learned from."""
    return training_texts(docs.where(fold("doc_id", folds) != held).select("doc_id", "text", "lang"), rows, chars)
