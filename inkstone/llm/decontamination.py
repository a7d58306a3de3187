"""Benchmark decontamination by latent semantic retrieval.

Texts are reduced to the benchmark's own words, weighted by inverse document frequencies over all documents.  A
distributed randomised SVD of the TF-IDF passages of the corpus gives a latent space; overlapping windows of every whole
text are compared by cosine with all items there.  Copies have an exact route beside it, by the rarest words of each item.
Candidates are verified by the longest common subsequence of words, and, where that alone leaves a paraphrase open, by the
item's answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, materialize, tune

WORD = re.compile(r"[^\W_]+")
#: Rank and oversampling of the SVD; words of a passage of the corpus.
RANK, OVERSAMPLE, PASSAGE = 64, 16, 64
#: Rows that are added up side by side in the SVD, how many such groups are held at once, and words of a block of sums.
GROUP, HELD_GROUPS, ROWS = 16, 512, 256
#: Words of the smallest blocks of which windows are made; documents whose windows are looked at together.
BLOCK, TOGETHER = 8, 64
#: Words of such documents at most, unless there is one alone; words and products whose vectors are held at once.
WORDS_TOGETHER, HELD_WORDS, HELD_PRODUCTS = 65_536, 65_536, 4_000_000
#: Items at most, so that what is broadcast is bounded.
MAX_ITEMS, MAX_WORDS = 200_000, 400_000
#: The least cosine of a candidate; shares of an item's words in the common subsequence: enough alone, and with the answer.
LEAST_COSINE, COPY, PARAPHRASE = 0.6, 0.8, 0.5
#: Fewest words in a common subsequence.
LEAST_WORDS = 6


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@dataclass
class Items:
    """The benchmark: ids, each item's word numbers, its answer's, and the vocabulary."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vocab: dict[str, int]


def read_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", answer_col: str | None = None) -> Items:
    """Items in order of id, of at most MAX_ITEMS; those with a null id or without a word are left out.

    The answer is the answer column, or else the item's last sentence.
    """
    cols = [F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"), (F.col(answer_col) if answer_col else F.lit(None)).cast("string").alias("a")]
    rows = benchmark.select(*cols).where("i is not null and t is not null").distinct().orderBy("i", "t", "a").limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} items: decontaminate against them in parts")
    vocab: dict[str, int] = {}
    out = Items([], [], [], vocab)
    for r in rows:
        if not (w := words_of(r.t)):
            continue
        last = [s for s in re.split(r"[.!?\n]+", r.t) if words_of(s)]
        pair = [np.array([vocab.setdefault(x, len(vocab)) for x in ws], np.int32) for ws in (w, words_of(r.a if r.a is not None else last[-1] if last else r.t))]
        out.ids.append(r.i)
        out.words.append(pair[0])
        out.answers.append(pair[1])
    if len(vocab) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} words in the items")
    return out


def _numbers(held):
    """(doc_id, words): the numbers of each whole text's words, 0 for words that no item has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = {w: i + 1 for w, i in held.value.vocab.items()}.get
        for pdf in batches:
            rows = []
            for t in pdf.text:
                w = words_of(t)
                x = np.fromiter(map(get, w, [0] * len(w)), "<i4", len(w))
                rows.append(x.tobytes())
            yield pd.DataFrame({"doc_id": pdf.doc_id, "words": rows})

    return run


def _frequencies(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, df = 0, np.zeros(size + 1, np.int64)
        for pdf in batches:
            for raw in pdf.words:
                x = np.frombuffer(raw, "<i4")
                df[np.unique(x)] += 1
            n += len(pdf)
        df[0] = n
        yield pd.DataFrame({"word": np.arange(size + 1), "n": df})

    return run


def _weighted(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the known words of a text, and their numbers."""
    x = np.frombuffer(raw, "<i4")
    at = np.flatnonzero(x)
    return at, x[at] - 1


def run_sums(rows: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``rows[at]`` over the runs that begin at ``starts``; the last row is zero.

    Runs are filled up with that row to groups of GROUP, a bounded number of which is gathered at once.
    """
    sizes = np.diff(np.r_[starts, len(at)])
    groups = -(-sizes // GROUP)
    first = np.cumsum(groups) - groups
    full = np.full((int(groups.sum()), GROUP), len(rows) - 1)
    full.ravel()[np.arange(len(at)) + np.repeat(first * GROUP - starts, sizes)] = at
    sums = np.empty((len(full), rows.shape[1]), rows.dtype)
    for k in range(0, len(full), HELD_GROUPS):
        np.einsum("gkj->gj", np.take(rows, full[k : k + HELD_GROUPS], axis=0), out=sums[k : k + HELD_GROUPS])
    return np.add.reduceat(sums, first)


def _project(p: np.ndarray, w: np.ndarray, idf: np.ndarray, scaled: np.ndarray, total: np.ndarray, weight: float = 1.0) -> int:
    """Adds A'A Q for the words w of the passages p, in order of passage; A: TF-IDF passages with unit rows.  Returns how
    many there are.  scaled: Q times idf, and a row of zeros.  Whole passages are taken, about HELD_WORDS words at once."""
    n, k = 0, 0
    while k < len(p):
        end = k + int(np.searchsorted(p[k:], p[min(k + HELD_WORDS, len(p)) - 1], "right"))
        some, own = p[k:end], w[k:end]
        starts = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
        at = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(some)]))
        key, tf = np.unique(at * len(idf) + own, return_counts=True)  # counts of a word in a passage
        norm2 = np.bincount(key // len(idf), (tf * idf[key % len(idf)]).astype(np.float64) ** 2)
        y = np.zeros((len(starts) + 1, scaled.shape[1]), scaled.dtype)
        y[:-1] = run_sums(scaled, own, starts) / norm2[:, None]
        order = np.argsort(own, kind="stable")
        words = own[order]
        first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
        total[words[first]] += run_sums(y, at[order], first) * (weight * idf[words[first], None].astype(np.float64))
        n, k = n + len(starts), end
    return n


def _power(held):
    """Partial sums of A'A Q over the passages of a task, in blocks of ROWS words, and under -1 how many there were."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, scaled = held.value
        total, n = np.zeros((len(idf), scaled.shape[1])), 0
        for pdf in batches:
            lengths = np.array([len(raw) // 4 for raw in pdf.words], np.int64)
            passages = -(-lengths // PASSAGE)
            x = np.frombuffer(b"".join(pdf.words), "<i4")
            at = np.flatnonzero(x)
            text = np.repeat(np.arange(len(lengths)), lengths)[at]
            p = (at - (np.cumsum(lengths) - lengths)[text]) // PASSAGE + (np.cumsum(passages) - passages)[text]
            n += _project(p, x[at] - 1, idf, scaled, total)
        at = [k for k in range(0, len(total), ROWS) if total[k : k + ROWS].any()]
        yield pd.DataFrame({"block": [-1, *(k // ROWS for k in at)], "sums": [np.full(1, float(n)).tobytes(), *(total[k : k + ROWS].tobytes() for k in at)]})

    return run


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sums of each block over all tasks."""
    out: dict[int, np.ndarray] = {}
    for pdf in batches:
        for block, raw in zip(pdf.block.tolist(), pdf["sums"], strict=True):
            x = np.frombuffer(raw, np.float64)
            out[block] = out[block] + x if block in out else x
    yield pd.DataFrame({"block": list(out), "sums": [x.tobytes() for x in out.values()]})


def latent_space(numbers: DataFrame, items: Items, idf: np.ndarray, rank: int = RANK, seed: int = 17) -> np.ndarray:
    """Right singular vectors (words x rank) of TF-IDF passages by a randomised range finder with one power step.

    It is fitted on all passages of all documents, and on the items, which weigh as much as all of the others together.
    The words x (rank + oversampling) matrix is summed map-side per task, then per block; its size is bounded by that of the
    items.
    """
    spark, size = numbers.sparkSession, len(idf)
    width = min(size, rank + OVERSAMPLE)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    scaled = np.vstack([idf[:, None] * q, np.zeros(width)]).astype(np.float32)
    held = spark.sparkContext.broadcast((idf, scaled))
    sums = "block int, sums binary"
    got = numbers.mapInPandas(_power(held), sums).repartition("block").mapInPandas(_added, sums).toPandas()
    z, n = np.zeros((size, width)), 0.0
    for block, raw in zip(got.block.tolist(), got["sums"], strict=True):
        x = np.frombuffer(raw, np.float64)
        if block < 0:
            n = float(x[0])
        else:
            z[block * ROWS : (block + 1) * ROWS] = x.reshape(-1, width)
    numbers_ = np.repeat(np.arange(len(items.ids)), [len(w) for w in items.words])
    _project(numbers_, np.concatenate(items.words), idf, scaled, z, max(1.0, n / len(items.ids)))
    u, _, _ = np.linalg.svd(z, full_matrices=False)
    return u[:, : min(rank, width)].astype(np.float32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming over a."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        if m := places.get(x):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def window_levels(raws: list[bytes], scaled: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For spans of 2 * BLOCK words, doubling up to ``top``: (span, text number, first word, latent sum) of each window.

    A window is two neighbouring blocks of one text, so windows begin every half span.  Sums of blocks are added up level
    by level; each text fills whole blocks of the top level.
    """
    per_text = np.array([-(-max(1, len(r) // 4) // top) * (top // BLOCK) for r in raws])
    base = np.cumsum(per_text) - per_text
    at_w = [_weighted(r) for r in raws]
    block = np.concatenate([at // BLOCK + b for (at, _), b in zip(at_w, base.tolist(), strict=True)])
    words = np.concatenate([w for _, w in at_w])
    sums = np.zeros((int(per_text.sum()), scaled.shape[1]), np.float32)
    if len(words):
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for k in range(0, len(starts), HELD_WORDS // BLOCK):
            some = starts[k : k + HELD_WORDS // BLOCK]
            end = starts[k + len(some)] if k + len(some) < len(starts) else len(words)
            sums[block[some]] = np.add.reduceat(scaled[words[some[0] : end]], some - some[0])
    text, first = np.repeat(np.arange(len(raws)), per_text), (np.arange(len(sums)) - np.repeat(base, per_text)) * BLOCK
    size = BLOCK
    while True:
        same = text[1:] == text[:-1]
        yield 2 * size, text[:-1][same], first[:-1][same], (sums[:-1] + sums[1:])[same]
        if 2 * size >= top:
            return
        sums, text, first, size = sums[::2] + sums[1::2], text[::2], first[::2], 2 * size


def bundles(raws: list[bytes], top: int) -> Iterator[tuple[list[int], int]]:
    """(places, top) of texts that are looked at together: their levels go no further than an item can be long of which
    they hold the half, so short texts beside long items take little memory."""
    n = np.array([max(1, len(r) // 4) for r in raws])
    tops = np.clip(2 ** np.ceil(np.log2(2 * n)).astype(np.int64), 2 * BLOCK, top)
    some, words = [], 0
    for i in np.argsort(tops, kind="stable").tolist():
        if some and (tops[i] != tops[some[-1]] or len(some) == TOGETHER or words + n[i] > WORDS_TOGETHER):
            yield some, int(tops[some[-1]])
            some, words = [], 0
        some.append(i)
        words += n[i]
    if some:
        yield some, int(tops[some[-1]])


def spans_of(lengths: np.ndarray) -> np.ndarray:
    """The span of the windows that items of so many words are compared with."""
    return np.maximum(2 * BLOCK, 2 ** np.ceil(np.log2(lengths)).astype(int))


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of some runs of a flat array, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def near_pairs(y: np.ndarray, items: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places of windows and items whose product reaches the window's least; a bounded number of products at once."""
    step = max(1, HELD_PRODUCTS // max(1, len(items)))
    for k in range(0, len(y), step):
        for i, j in zip(*np.nonzero(y[k : k + step] @ items.T >= least[k : k + step, None]), strict=True):
            yield k + int(i), int(j)


class Anchors:
    """The exact route to the copies in a text; neither rank nor cosine has a part in it.

    A copy leaves out at most n - need of an item's n words, need being ceil(COPY * n), so one of that many and one more of
    its rarest words is in the text.  Of such items, every window that the latent search could look at, and that has
    ``need`` of the item's words in any order, is given.
    """

    def __init__(self, items: Items, idf: np.ndarray):
        self.items, size = items, len(idf)
        self.n = np.array([len(w) for w in items.words])
        self.spans = spans_of(self.n)
        self.need = np.ceil(np.maximum(COPY * self.n, np.minimum(LEAST_WORDS, self.n)) - 1e-9).astype(int)
        self.flat, self.starts = np.concatenate(items.words), np.cumsum(self.n) - self.n
        rare = [np.unique(w[np.argsort(-idf[w], kind="stable")[: len(w) - need + 1]]) for w, need in zip(items.words, self.need.tolist(), strict=True)]
        item, word = np.repeat(np.arange(len(rare)), [len(w) for w in rare]), np.concatenate(rare)
        self.posting = item[np.argsort(word, kind="stable")]
        self.n_posting = np.bincount(word, minlength=size)
        self.starts_posting = np.cumsum(self.n_posting) - self.n_posting
        self.present, self.own = np.zeros(size, bool), np.zeros(size, bool)

    def windows(self, at: np.ndarray, w: np.ndarray, length: int) -> Iterator[tuple[int, int, int, float]]:
        """(item, start, end, most): of the known words of a text, those in a window, and the largest share they can have."""
        u = np.unique(w)
        items = np.unique(self.posting[gather(self.starts_posting[u], self.n_posting[u])])
        if not len(items):
            return
        n = self.n[items]
        self.present[u] = True
        of_item = np.add.reduceat(self.present[self.flat[gather(self.starts[items], n)]], np.cumsum(n) - n, dtype=np.int64)
        self.present[u] = False
        for item in items[of_item >= self.need[items]].tolist():
            words, span = self.items.words[item], int(self.spans[item])
            self.own[words] = True
            places = at[self.own[w]]
            self.own[words] = False
            first = np.arange(0, max(1, length), span // 2)
            s, e = first - span // 2, first + span + span // 2
            count = np.searchsorted(places, e) - np.searchsorted(places, s)
            for k in np.flatnonzero(count >= self.need[item]).tolist():
                a, b = np.searchsorted(at, [s[k], e[k]])
                yield item, int(a), int(b), min(1.0, int(count[k]) / len(words))


def _search(held):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, idf, v = held.value
        scaled = (idf[:, None] * v).astype(np.float32)
        lengths = np.array([len(w) for w in items.words])
        latent = np.stack([scaled[w].sum(0) for w in items.words])
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        verifier = Verifier(items, len(idf))
        # items by length: a window is compared with those that are about as long as it is
        spans, anchors = spans_of(lengths), Anchors(items, idf)
        for pdf in batches:
            rows, all_ids, all_raws = [], pdf.doc_id.tolist(), pdf.words.tolist()
            for places, top in bundles(all_raws, int(spans.max())):
                ids, raws = [all_ids[i] for i in places], [all_raws[i] for i in places]
                found: dict[tuple[int, int], float] = {}
                known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                for span, text, first, y in window_levels(raws, scaled, top):
                    own = np.flatnonzero(spans == span)
                    if not len(own):
                        continue
                    least = LEAST_COSINE * np.maximum(np.sqrt(np.einsum("ij,ij->i", y, y)), 1e-9)
                    for i, j in near_pairs(y, latent[own], least):
                        t, item = int(text[i]), int(own[j])
                        at, w = known[t] if t in known else known.setdefault(t, _weighted(raws[t]))
                        s, e = np.searchsorted(at, [first[i] - span // 2, first[i] + span + span // 2])
                        if (share := verifier.share(item, w[s:e])) > found.get((t, item), 0.0):
                            found[t, item] = share
                for t, raw in enumerate(raws):
                    at, w = known[t] if t in known else _weighted(raw)
                    for item, s, e, most in anchors.windows(at, w, len(raw) // 4):
                        if most > (best := found.get((t, item), 0.0)) and (share := verifier.share(item, w[s:e])) > best:
                            found[t, item] = share
                rows += [(ids[t], items.ids[j], float(x)) for (t, j), x in found.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "share"])

    return run


class Verifier:
    """Checks an item against the words of a window."""

    def __init__(self, items: Items, size: int):
        self.items, self.size = items, size
        self.member: dict[int, np.ndarray] = {}  # for some items, which words they have
        self.present = np.zeros(size, bool)

    def share(self, item: int, window: np.ndarray) -> float:
        """The item's share in the common subsequence with the window, or 0 if that is too little."""
        words, answer = self.items.words[item], self.items.answers[item]
        least = max(PARAPHRASE * len(words), min(LEAST_WORDS, len(words)))
        # no common subsequence is longer than the words of either that the other has
        if (has := self.member.get(item)) is None:
            if len(self.member) * self.size > 1 << 26:
                self.member.clear()
            has = self.member[item] = np.zeros(self.size, bool)
            has[words] = True
        if np.count_nonzero(has[window]) < least:
            return 0.0
        self.present[window] = True
        of_item = np.count_nonzero(self.present[words])
        self.present[window] = False
        if of_item < least or (common := common_subsequence(words, window)) < least:
            return 0.0
        return common / len(words) if common >= COPY * len(words) or common_subsequence(answer, window) == len(answer) else 0.0


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """(doc_id, item_id, share): documents that hold an item, and the share of its words in the common subsequence.

    A pair is returned if a window's common subsequence has COPY of the item's words; all such pairs are found.  It is also
    returned if a window that is near enough in the latent space has PARAPHRASE of them and the item's whole answer.  Null and empty texts hold nothing; items with null ids or no words are left out; documents with null ids are
    returned with null; repeated rows give repeated pairs no more than once; empty tables give no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    schema = "doc_id long, item_id long, share double"
    items = read_items(benchmark, answer_col=answer_col)
    if not items.ids:
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(items)
    numbers = materialize(as_text(docs, id_col, text_col).where("text is not null").mapInPandas(_numbers(held), "doc_id long, words binary"), "numbers")
    size = len(items.vocab)
    got = numbers.mapInPandas(_frequencies(size), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()  # a row per word
    df = np.zeros(size + 1)
    df[got.word] = got.n
    idf = np.log((1 + df[0]) / (1 + df[1:])).astype(np.float32) + np.float32(0.1)
    space = latent_space(numbers, items, idf)
    everything = spark.sparkContext.broadcast((items, idf, space))
    found = numbers.mapInPandas(_search(everything), schema)
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def flags(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """(doc_id, contaminated, item_ids, share) for each row of ``docs``: item_ids in order, share the largest."""
    found = contaminated(docs, benchmark, **names).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("share").alias("share"))
    rows = docs.select(F.col(names.get("id_col", "doc_id")).cast("long").alias("d")).join(found, F.expr("d <=> doc_id"), "left")
    return rows.select(F.col("d").alias("doc_id"), F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("share", F.lit(0.0)).alias("share"))
