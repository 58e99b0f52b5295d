"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablebridge.llm import centroids, chat, decontaminate, divergence, fingerprint, html_text, language_id, mixing, ngram_join, pii, token_counts, toxicity, url_filter
from tablebridge.llm.common import fold, read, text_batches

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
PROBE_CONVERSATION = r"\### Assistant: </turn> ok"


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return html_text.extract(read(spark, sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    found = pii.find(read(spark, sf_dir, "documents"))
    return found.withColumn("spans", pii.spans_text(F.col("spans")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return ngram_join.ngram_join(read(spark, sf_dir, "documents"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return fingerprint.neighbours(read(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE_CONVERSATION), (-7, 1, "assistant", PROBE_CONVERSATION)], rows.schema)
    back = chat.read_back(chat.windows(rows.union(probe)))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["target"].isNotNull()), lambda t: t["target"]), "")
    told = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), joined.alias("joined"), loss.alias("loss"), "formatted_chars")
    return told.select("conv_id", "n_turns", F.sha2("joined", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    docs = read(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.learn(docs))
    return found.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark, 4096)
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return told.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark, 4096)
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, new on each call, so that every different text is encoded."""
    import public_tokenizers

    text_batches(spark)
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), token_counts.Tokenizer(public_tokenizers.path("piece_bpe_32k.model")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return divergence.audit(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_ngram_join": op4_ngram_join,
    "op5_fingerprint": op5_fingerprint,
    "op6_chat": op6_chat,
    "op7_language_id": op7_language_id,
    "op8_url_filter": op8_url_filter,
    "op9_mixing": op9_mixing,
    "op10_decontaminate": op10_decontaminate,
    "op11_centroids": op11_centroids,
    "op12_token_counts": op12_token_counts,
    "op13_source_divergence": op13_source_divergence,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _centroid_sql(rounds: int = 5) -> str:
    """One pair of steps a round: every vector takes its nearest centroid, every centroid the floor of its vectors' mean."""
    steps = """
        WITH v AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h) - 1 AS k, q FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, q FROM v ORDER BY h LIMIT 40)
        )"""
    for i in range(rounds + 1):
        steps += f""", a{i} AS MATERIALIZED (
            SELECT vec_id, q, min({{'d': d, 'k': k}}) AS best
            FROM (SELECT vec_id, v.q, k, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{i} c) GROUP BY vec_id, q
        )"""
        if i < rounds:
            steps += f""", s{i} AS (
            SELECT k, list(m ORDER BY dim) AS q FROM (
                SELECT k, dim, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
                FROM (SELECT best.k AS k, unnest(q) AS x, unnest(range(64)) AS dim FROM a{i}) GROUP BY k, dim) GROUP BY k
        ), c{i + 1} AS MATERIALIZED (
            SELECT k, coalesce(s.q, c.q) AS q FROM c{i} c LEFT JOIN s{i} s USING (k)
        )"""
    return steps + f"""
        SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
               CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON c.k = a.best.k
    """


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = {
    "op11_centroids": _centroid_sql(),
    "op13_source_divergence": f"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS w FROM documents
        ), occ AS (
            SELECT lang, source, r, unnest(w) AS term FROM docs
        ), kept AS (
            SELECT lang, term, count(*) AS n FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= 3
        ), langs AS (
            SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
        ), cnt AS (
            SELECT lang, source, term, count(*) AS c FROM occ SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
        ), grp AS (
            SELECT lang, source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN cnt USING (lang, source) GROUP BY lang, source
        ), shares AS MATERIALIZED (
            SELECT lang, source, term, coalesce(c, 0) AS c, CAST(1 + (1000000000 * (coalesce(c, 0) + 1)) // (grp.n + v) AS BIGINT) AS p
            FROM grp JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN cnt USING (lang, source, term)
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), ranked AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
            FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT)
            FROM shares JOIN (SELECT lang, term, CAST(1 + (1000000000 * (kept.n + 1)) // (langs.n + v) AS BIGINT) AS q FROM kept JOIN langs USING (lang)) USING (lang, term) WHERE c > 0 AND p > q
        )
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM ranked) WHERE part = 'pair' OR rank <= 200
    """,
    "op8_url_filter": """
        WITH cut AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut
        ), rules(h, p, verdict) AS (
            VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
        ), hits AS (
            SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
            FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN hits USING (page_id)
    """,
    "op10_decontaminate": f"""
        WITH items AS (
            SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark
        ), wins AS (
            SELECT item, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS win
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
        ), docs AS (
            SELECT doc_id, {_WORDS} AS w FROM documents
        ), places AS (
            SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs
        ), sizes AS (
            SELECT DISTINCT n FROM wins
        ), found AS (
            SELECT d.doc_id, d.i, d.n, wins.item
            FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM places, sizes WHERE i + n - 1 <= len(w)) d
            JOIN wins ON d.win = wins.win AND d.n = wins.n
        ), hits AS (
            SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id
        ), names AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)
    """,
}
