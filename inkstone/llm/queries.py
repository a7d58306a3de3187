"""Thin queries over the tables of a folder, one per operator; the digest columns are made from the operators' results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontamination, embedding_graph, language_id, pii, secret_scan, warc
from .common import table
from .ngram_join import ngram_jaccard_join
from .substring_dedup import substring_dedup


def word_bpe_path() -> str:
    """The vocabulary's file, which a worker reads by path."""
    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), k=3, percent=90).drop("class_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secret_scan.scan_in_batches(table(spark, sf_dir, "documents"), 2)
    kinds = [kind for kind, _, _ in secret_scan.RULES]
    n = [secret_scan.count_of(F.col("findings"), kind).alias(f"n_{kind}") for kind in kinds]
    spans = secret_scan.spans_of(F.col("findings"), kinds)
    return found.select("doc_id", *n, F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_graph.embedding_near_dedup(table(spark, sf_dir, "embeddings")).drop("audited_recall")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=20, batches=2).drop("kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.predict(docs, model).select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: A conversation about the template's own control strings, beside those of the table.
TRICKY = r"\### Assistant: </turn> ok"


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents")).drop("text")
    n = [pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *n, F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], turns.schema)
    return chat_format.read_back(chat_format.format_turns(turns.unionByName(own))).drop("attachment_tokens")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.with_digests(bpe.encode_decode(table(spark, sf_dir, "documents"), word_bpe_path()))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op1_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (
    SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)
), reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, least(d.doc_id, min(r.y)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id""",
    "op2_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
), r AS (SELECT *, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r""",
    "op4_embedding_near_dedup": """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), c AS (SELECT x, min(y) AS least FROM reach GROUP BY x), n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, c.least) AS component_id, e.vec_id = least(e.vec_id, c.least) AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN c ON c.x = e.vec_id""",
    "op5_substring_dedup": f"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents
), p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), k AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 19 <= len(ws) THEN array_to_string(ws[i:i + 19], ' ') END AS key FROM p
), r AS (SELECT doc_id, i, word, key IS NOT NULL AND row_number() OVER (PARTITION BY key ORDER BY doc_id, i) > 1 AS again FROM k
), g AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r
), t AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op9_chat_format": r"""
WITH t AS (
    SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS own(i, r)
), f AS (SELECT *, concat('### ', replace(regexp_replace(role, '(\\|### |</turn>|<\|)', '\\\1', 'g'), ':', '\:'), ': ', regexp_replace(text, '(\\|### |</turn>|<\|)', '\\\1', 'g'), '</turn>', chr(10)) AS formatted FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, formatted)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, formatted) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id""",
}


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; tests hold the others against brute force."""
    return dict(ORACLES)
