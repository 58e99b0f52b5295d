"""Token counts with a digest cache.

A text is known by the SHA-256 of its normal form, a tokenizer by the SHA-256 of its library, version and file. A table of
(tokenizer, digest, n_tokens) keeps what was counted. Texts are joined to it by their digests alone; only texts that it lacks
are encoded, each different one once, and appended to it.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablebridge.llm.common import hot_keys, split_join, stored
from tablebridge.sources.shared import exists, shared_path

#: Tokens beyond which a text is over the limit.
LIMIT = 4096
#: Digests that may be broadcast (32 bytes each), and the largest tokenizer file, which goes to every task.
BROADCAST_DIGESTS, MODEL_BYTES = 1_000_000, 64 << 20
# File endings and the libraries that read them.
LIBRARIES = {".json": "tokenizers", ".model": "sentencepiece"}


class Tokenizer:
    """A vocabulary file, read on the driver and sent to the tasks: workers need no path."""

    def __init__(self, path: str):
        self.kind = Path(path).suffix
        if self.kind not in LIBRARIES:
            raise ValueError(f"{path}: no library for {self.kind or 'a file without ending'}")
        self.data = Path(path).read_bytes()
        if len(self.data) > MODEL_BYTES:
            raise ValueError(f"{path}: {len(self.data)} bytes; a tokenizer file has at most {MODEL_BYTES}")
        library = LIBRARIES[self.kind]
        self.version = hashlib.sha256(f"{library} {importlib.metadata.version(library)}\n".encode() + self.data).hexdigest()

    def counter(self) -> Callable[[list[str]], list[int]]:
        """The numbers of tokens of texts: no begin, end or other special tokens are added, nothing is cut or padded."""
        if self.kind == ".model":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=self.data)
            return lambda texts: [len(x) for x in model.encode(texts, num_threads=1, add_bos=False, add_eos=False)]
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        model = tokenizers.Tokenizer.from_str(self.data.decode())
        model.no_truncation()
        model.no_padding()
        return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def filled(text: Column) -> Column:
    """The normal form where the tokenizer keeps every character: a null text is the empty one."""
    return F.coalesce(text.cast("string"), F.lit(""))


def encoded(texts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """digest, n_tokens of texts (digest, text)."""
    sent = texts.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = sent.value.counter()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(count(batch.column("text").to_pylist()), pa.int64())], ["digest", "n_tokens"])

    return texts.mapInArrow(run, "digest binary, n_tokens long")


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """digest, n_tokens of a tokenizer, each digest once, or None where the cache has none. Two runs that append the same digest, or one cut off while it appends, do no harm: a row is right by itself."""
    path = f"{cache}/tokenizer={version}"
    if not exists(spark, path):
        return None
    return spark.read.schema("digest binary, n_tokens long").parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: Tokenizer, cache: str | None = None, limit: int = LIMIT, normal: Callable[[Column], Column] = filled) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text).

    n_bytes is the UTF-8 length of the text itself, n_tokens the tokens of its normal form, which must be one that keeps the count.
    `cache` is a folder that executors share; without one a new folder is used, so that nothing but repeated texts is spared.
    A null text is the empty one and has 0 bytes. Repeated rows and ids each get their row; an empty table gives none. Texts of any
    length are encoded whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    cache = cache or shared_path(spark, "token-counts")
    content = normal(F.col("text"))
    digest = F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest")
    size = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long")
    rows = stored(docs.select("doc_id", size.alias("n_bytes"), digest, F.monotonically_increasing_id().alias("row")), "digests")
    each = stored(rows.groupBy("digest").agg(F.count("*").alias("copies")), "contents")
    known = cached(spark, cache, tokenizer.version)
    missing = each.select("digest") if known is None else stored(each.join(known, "digest", "left_anti").select("digest"), "missing")
    texts = docs.select(digest, content.alias("text"))
    few = known is not None and missing.count() <= BROADCAST_DIGESTS
    if few:
        texts = texts.join(F.broadcast(missing), "digest", "left_semi")  # known texts stay where they are
    once = texts.dropDuplicates(["digest"])  # copies meet inside each task first
    if known is not None and not few:
        once = once.join(missing, "digest", "left_semi")
    encoded(once, tokenizer).write.mode("append").parquet(f"{cache}/tokenizer={tokenizer.version}")
    hot = [bytes(x) for x in hot_keys(each, "digest", "copies", rows.count())]
    counted = split_join(rows, cached(spark, cache, tokenizer.version), "digest", "row", hot)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
