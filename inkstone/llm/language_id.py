"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts cover every training row and are summed in Spark.  Only the log-probability matrix, whose size is fixed by
``buckets`` and ``max_langs``, is broadcast; batches of texts are scored with sparse gathers in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, tune

UNKNOWN = "und"
#: N-grams that are looked up or counted at once.
PIECE = 500_000
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def ngrams(text: str | None, orders: tuple[int, ...], buckets: int) -> np.ndarray:
    """Buckets of all n-grams of the whole text in lower case, everything but letters as one kind of space."""
    if not text:
        return np.empty(0, np.int64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = letters()[c]
    if not ok.any():
        return np.empty(0, np.int64)
    c = np.where(ok, c, np.uint32(32)).astype(np.uint64)
    c = c[ok | np.r_[False, ok[:-1]]]  # one space of a run, and none at the start
    c = np.r_[np.uint64(32), c, np.full(int(c[-1] != 32), np.uint64(32))]
    out = []
    for n in orders:
        acc = np.full(max(0, len(c) - n + 1), np.uint64(n))
        for i in range(n):
            acc = acc * np.uint64(0x100000001B3) + c[i : i + len(acc)]
        out.append(mix64(acc) & np.uint64(buckets - 1))
    return np.concatenate(out).astype(np.int64)


@dataclass
class LanguageModel:
    """langs in order, log-probabilities as (buckets, langs), and log priors."""

    langs: list[str]
    log_prob: np.ndarray
    log_prior: np.ndarray
    orders: tuple[int, ...]
    buckets: int


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", orders: tuple[int, ...] = (1, 2, 3), buckets: int = 1 << 16, max_langs: int = 256, alpha: float = 0.5) -> LanguageModel:
    """Naive Bayes from all rows with a non-null text and language; buckets is a power of two.

    Without any such row the model knows no language and predicts ``und`` throughout.
    """
    spark = rows.sparkSession
    tune(spark)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                sums.setdefault(lang, np.zeros(buckets, np.int64))
                docs[lang] = docs.get(lang, 0) + len(part)
                held, size = [], 0
                for t in [*part.text, None]:  # a bounded number of n-grams at once
                    if t is None or size > PIECE:
                        if held:
                            sums[lang] += np.bincount(np.concatenate(held), minlength=buckets)
                        held, size = [], 0
                    if t is not None:
                        held.append(ngrams(t, orders, buckets))
                        size += len(held[-1])
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pd.DataFrame({"lang": lang, "bucket": np.r_[-1, at], "n": np.r_[docs[lang], s[at]]})

    labelled = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counts = labelled.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = [r.lang for r in labelled.select("lang").distinct().orderBy("lang").limit(max_langs + 1).collect()]
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    got = counts.toPandas()  # at most langs x (buckets + 1) rows
    table, docs = np.zeros((buckets, len(langs))), np.zeros(len(langs))
    for j, lang in enumerate(langs):
        own = got[got.lang == lang]
        docs[j] = own.n[own.bucket < 0].sum()
        own = own[own.bucket >= 0]
        table[own.bucket, j] = own.n
    log_prob = np.log(table + alpha) - np.log(table.sum(0) + alpha * buckets)
    return LanguageModel(langs, log_prob, np.log(np.maximum(docs, 1) / max(docs.sum(), 1)), orders, buckets)


def score_texts(m: LanguageModel, texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Language and posterior probability of each text of a batch."""
    lang, best = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    for i, t in enumerate(texts if m.langs else []):
        grams = ngrams(t, m.orders, m.buckets)
        if not len(grams):
            continue
        pieces = range(0, len(grams), PIECE)  # a long text has very many n-grams
        sums = sum((m.log_prob[grams[k : k + PIECE]].sum(0) for k in pieces), m.log_prior)
        p = np.exp(sums - sums.max())
        top = int(sums.argmax())
        lang[i], best[i] = m.langs[top], p[top] / p.sum()
    return lang, best


def accepted(text: Column, model: LanguageModel, least: float = 0.5) -> Column:
    """Whether a text has letters and its language is known with at least this probability; with no model, true."""
    held = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def ok(texts: pd.Series) -> pd.Series:
        lang, best = score_texts(held.value, texts)
        return pd.Series((lang != UNKNOWN) & (best >= least) if held.value.langs else np.ones(len(texts), bool))

    return ok(text)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the most probable language of each whole text and its posterior probability.

    Null texts, texts without a letter, and all texts if the model knows no language: ``und`` and 0.  Of equal scores the
    first language by name wins.  Rows that repeat or have a null id are scored like any other; an empty table gives no
    rows; only the two columns are read.
    """
    spark = docs.sparkSession
    tune(spark)
    held = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lang, best = score_texts(held.value, pdf.text)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "lang_pred": lang, "score": best})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(score, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """One document in five by its id's CRC-32 is never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
