"""From raw documents to token ids: language, near copies, benchmark leaks, personal data, encoding.

Each stage works on all rows that the one before kept, and is written and read again before the next.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import bpe, decontamination, language_id, pii
from inkstone.llm.common import materialize, table, tune
from inkstone.llm.ngram_join import keep_one_of_each
from inkstone.llm.queries import word_bpe_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a text in a language that the labelled ones teach; others go."""
    tune(spark)
    model = language_id.fit(docs)
    return docs.where(language_id.accepted(F.col("text"), model))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links at a Jaccard similarity of 0.8 of five-word shingles: the smallest id."""
    return keep_one_of_each(docs, k=5, percent=80)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: each row by its own text (a 64-bit hash of it), also with a null or repeated id."""
    key = F.xxhash64("text")
    found = decontamination.contaminated(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(found, key == F.col("_leak"), "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data redacted and n_chars counted anew."""
    tagger = pii.train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    out = docs.withColumn("text", pii.redacted(F.col("text"), tagger))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document."""
    return bpe.encode_decode(docs, word_bpe_path()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language", language), ("near_copies", near_copies), ("leaks", leaks), ("personal_data", personal_data), ("tokens", tokens)]

#: Language models, taggers and encodings can't be said in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name, free=True)
    return STAGES[-1][1](spark, docs, sf_dir)
