"""A training corpus from documents: language, near duplicates, benchmark passages, personal data, source mix."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablebridge.llm import decontaminate, language_id, mixing, ngram_join, pii
from tablebridge.llm.common import bounded_broadcast, read, split_join, stored, text_batches
from tablebridge.sources import shared

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REST = COLUMNS[1:]
#: Ids that may be broadcast: 8 MB.
BROADCAST_IDS = 1_000_000


def _hashed(docs: DataFrame) -> DataFrame:
    """docs with text_hash: ids may be null or repeated, so what is judged is a row's doc_id and text."""
    return docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))


def _same(rows: DataFrame, name: str):
    """rows (doc_id, text_hash) of which each is there once, stored, and the condition that a row of docs is one of them."""
    rows = stored(rows.select(F.col("doc_id").alias("judged_id"), F.col("text_hash").alias("judged_hash")).distinct(), name)
    return bounded_broadcast(rows, BROADCAST_IDS), F.col("doc_id").eqNullSafe(F.col("judged_id")) & (F.col("text_hash") == F.col("judged_hash"))


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that drops what it stored on its way, but for what its result still reads: so the result can be read for as long as the process lives, whatever other stages do."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with shared.Scope() as scratch:
            out = f(spark, docs, sf_dir)
            scratch.release(out)
        return out

    return run


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to which a learned language is assigned stay; those of null text or without a letter go, and all if no row has a language to learn. Rows are judged one by one, whatever their ids."""
    text_batches(spark)
    docs = docs.select(*COLUMNS)
    found = language_id.identify(docs, language_id.learn(docs), keep=REST)
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select(*COLUMNS)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays: of the least doc_id (null last), and among its rows of the least text hash. Texts without words are one class; an empty table stays empty."""
    text_batches(spark)
    docs = _hashed(docs)
    told = ngram_join.classes(docs, count_links=False).select("component", F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    rows = stored(told.groupBy("component", "unnamed", "doc_id", "text_hash").agg(F.count("*").alias("copies")), "classes")
    best = rows.groupBy("component").agg(F.min(F.struct("unnamed", "doc_id", "text_hash")).alias("best"))
    # a class may be large, that of texts without words for one: its rows are shared among tasks
    met = split_join(rows.withColumn("row", F.xxhash64("doc_id", "text_hash")), best, "component", "row")
    judged = stored(met.select("doc_id", "text_hash", "copies", (F.struct("unnamed", "doc_id", "text_hash") == F.col("best")).alias("stays")), "judged")
    gone, is_gone = _same(judged.where("NOT stays"), "gone")
    kept = docs.join(gone, is_gone, "left_anti")
    again = judged.where("stays AND copies > 1")
    if again.isEmpty():
        return kept.select(*COLUMNS)
    again, is_again = _same(again, "again")
    once = kept.join(again, is_again, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, is_again, "left_anti").union(once).select(*COLUMNS)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which at least a twentieth of the words are benchmark passages go; rows of null or empty text stay. Rows are judged by id and text, so others of the same id stay."""
    docs = _hashed(docs)
    told = decontaminate.contamination(docs.withColumnRenamed("text_hash", "row_hash"), read(spark, sf_dir, "benchmark"), keep=["row_hash"])
    gone, is_gone = _same(told.where("contaminated").withColumnRenamed("row_hash", "text_hash"), "gone")
    return docs.join(gone, is_gone, "left_anti").select(*COLUMNS)


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars is that of the new text, null where the text is null. Every row stays."""
    text_batches(spark)
    found = pii.find(docs.select(*COLUMNS), keep=REST)
    clean = found.withColumn("text", pii.redacted(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: shard, place, doc_id, source, epoch, first, last, words, text, lang. Each row is what its document gives to a shard in one of its epochs, rows of a shard in the order of their places.

    A document without words, or beyond its source's quota, gives nothing.
    """
    mixed = mixing.mix(docs.select(*COLUMNS), keep=["text", "lang"])
    return mixing.shard_rows(mixed, keep=["text", "lang"])


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
]

#: Suffix automata, MinHash classes and hypergeometric draws are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus of sf_dir/documents. A stage's rows are written before the next one starts; then all else that this run has stored is dropped, the rows of the stage before it among them."""
    docs = read(spark, sf_dir, "documents")
    with shared.Scope() as own:
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower().replace("-", ""))
            own.release(docs)
    return docs
