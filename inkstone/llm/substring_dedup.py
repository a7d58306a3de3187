"""Substring dedup over a log-structured fingerprint index.

Every window of ``window`` words has an anchor, the smallest hash among its short word runs (winnowing).  Equal windows
have equal anchors, so a row of the index is an anchor's occurrence with the hashes of the windows that it stands for:
a few bytes a window, dealt and sorted by anchor.  A run is such a sorted table and is never changed.  A batch of
documents is sorted the same way and merged with the runs in one pass; a window that a run or an earlier row of the
batch holds under the same anchor and hash (64 and 48 bits, so 112 in all) is a repeat.  What is new becomes the next
run, and small runs are merged into one when there are too many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import STEP, as_text, collect_garbage, drop, gram_hashes, materialize, mix64, signed, split_words, tune, word_hashes

#: Words of the runs among which a window's anchor is chosen.
ANCHOR_WORDS = 5
#: Bytes that are kept of a window's hash beside its anchor.
HASH_BYTES = 6
ROW_SCHEMA = "anchor long, doc_id long, part int, start int, hashes binary, flags binary"
ROW_COLUMNS = ["anchor", "doc_id", "part", "start", "hashes", "flags"]


def anchors_of_windows(grams: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` values the position of its smallest, the last of equals, by prefix minima of blocks."""
    n = len(grams) - span + 1
    pos = np.arange(len(grams))
    best, width = pos, 1
    while width * 2 <= span:  # doubling: best[i] is the position of the smallest of grams[i : i + width]
        left, right = best[: len(best) - width], best[width:]
        best, width = np.where(grams[right] <= grams[left], right, left), width * 2
    left, right = best[:n], best[span - width : span - width + n]
    return np.where(grams[right] <= grams[left], right, left)


def packs(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, end) of each run of windows with one anchor, and all window hashes."""
    grams = gram_hashes(h, ANCHOR_WORDS)
    at = anchors_of_windows(grams, window - ANCHOR_WORDS + 1)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return grams[at[starts]], starts, np.r_[starts[1:], len(at)], gram_hashes(h, window)


def short(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def runs_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches in which no column changes."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(change)
    return starts, np.append(starts[1:], len(change))


def binary(data: bytes, sizes: np.ndarray) -> pa.Array:
    """An Arrow column of the next ``sizes`` bytes of the data each."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def edges(starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Ranges of windows, one a row."""
    return binary(np.stack([starts, ends], 1).astype("<i4").tobytes(), np.full(len(starts), 8))


def later(key: np.ndarray, same: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray, repeated: bool) -> np.ndarray:
    """Which windows come behind the first with the same key: in a later document, or later in the same one.

    Windows are in order of document and start, unless ``repeated``: rows then share a document.  Windows that start at one
    place of one document, in rows that repeat it, are all the first.  same: what equal windows have in common.
    """
    order = np.lexsort((start, doc, key)) if repeated else np.argsort(key, kind="stable")
    fresh = np.ones(len(key), bool)
    fresh[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in same], axis=0)
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
    out = np.zeros(len(key), bool)
    out[order] = ~fresh
    if repeated:
        out[order] &= (doc[order] != doc[order[first]]) | (start[order] != start[order[first]])
    return out


def _fingerprints(window: int):
    """Rows of the documents of a task.  A window that an earlier document of the batch has needs no row: it is a repeat
    already and is flagged on the spot (pre-aggregation, which keeps passages that very many documents share cheap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = sorted(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "text")), strict=True), key=lambda x: x[:2])
            pairs = [(d, p, w) for d, p, t in pairs if len(w := split_words(t)) >= window]
            if not pairs:
                continue
            got = [packs(word_hashes(w), window) for _, _, w in pairs]
            docs, sizes = np.array([d for d, _, _ in pairs], np.int64), np.array([len(g[3]) for g in got])
            parts = np.array([p for _, p, _ in pairs], np.int32)
            base = np.cumsum(sizes) - sizes
            windows = np.concatenate([g[3] for g in got])
            anchors = np.concatenate([g[0] for g in got])
            doc = np.repeat(np.arange(len(docs)), sizes)
            pack = np.repeat(np.arange(len(anchors)), np.concatenate([g[2] - g[1] for g in got]))
            own = anchors[pack]
            again = later(mix64(windows + own * STEP), (windows, own), docs[doc], np.arange(len(doc)) - base[doc], len(np.unique(docs)) < len(docs))
            s, e = runs_of(pack, again)
            fresh = ~again[s]
            fs, fe = s[fresh], e[fresh]
            s, e = runs_of(doc, again)
            rs, re = s[again[s]], e[again[s]]
            n, m = len(fs), len(rs)
            columns = [
                pa.concat_arrays([pa.array(signed(anchors[pack[fs]])), pa.nulls(m, pa.int64())]),
                pa.array(docs[doc[np.concatenate([fs, rs])]]),
                pa.array(parts[doc[np.concatenate([fs, rs])]]),
                pa.array(np.concatenate([fs - base[doc[fs]], np.zeros(m, np.int64)]).astype(np.int32)),
                pa.concat_arrays([binary(short(windows[~again]), (fe - fs) * HASH_BYTES), pa.nulls(m, pa.binary())]),
                pa.concat_arrays([pa.nulls(n, pa.binary()), edges(rs - base[doc[rs]], re - base[doc[rs]])]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ROW_COLUMNS)

    return run


def _merge(keep: bool):
    """Rows by (anchor, old first, doc_id, start): of new rows, the ranges of windows that came before, as rows without an
    anchor; such rows also pass as they are.  keep: the new rows are given as well, for the next run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (None, None)
        for batch in batches:
            flagged = batch.filter(pc.is_null(batch.column("anchor"))).select(ROW_COLUMNS)
            if flagged.num_rows:
                yield flagged
            batch = batch.filter(pc.is_valid(batch.column("anchor")))
            if not batch.num_rows:
                continue
            found, state = _repeats(batch, *state)
            n = found.num_rows
            if n:
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), found.column("doc_id"), found.column("part"), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.binary()), found.column("flags")], ROW_COLUMNS)
            if keep:
                yield batch.filter(pc.invert(batch.column("old"))).select(ROW_COLUMNS)

    return run


def _repeats(batch: pa.RecordBatch, now: int | None, seen: tuple[np.ndarray, ...] | None) -> tuple[pa.RecordBatch, tuple]:
    """Ranges of windows of the new rows that came before; and the last anchor, with its windows so far and their places.

    The distinct windows of the current anchor are all that is held, 24 bytes each.
    """
    anchor, doc, start = (batch.column(c).to_numpy() for c in ("anchor", "doc_id", "start"))
    part, old = batch.column("part").to_numpy(), batch.column("old").to_numpy(zero_copy_only=False)
    packed = batch.column("hashes")
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    data = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets) // HASH_BYTES
    raw = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    raw[:, :HASH_BYTES] = data.reshape(-1, HASH_BYTES)
    wh = raw.view("<u8").ravel()
    row = np.repeat(np.arange(len(sizes)), sizes)
    shift = start - (np.cumsum(sizes) - sizes)
    group = np.zeros(len(anchor), np.int64)
    np.cumsum(anchor[1:] != anchor[:-1], out=group[1:])
    g, at_doc, at = group[row], doc[row], np.arange(len(wh)) + shift[row]
    n_seen = 0
    if seen is not None and anchor[0] == now:  # what the batches before had under the same anchor comes first
        n_seen = len(seen[0])
        wh, g = np.concatenate([seen[0], wh]), np.concatenate([np.zeros(n_seen, np.int64), g])
        at_doc, at = np.concatenate([seen[1], at_doc]), np.concatenate([seen[2], at])
    order = np.lexsort((wh, g))  # stable, so earlier rows come first
    fresh = np.ones(len(wh), bool)
    fresh[1:] = (wh[order[1:]] != wh[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
    first = order[np.maximum.accumulate(np.where(fresh, np.arange(len(wh)), 0))]
    dup = np.zeros(len(wh), bool)
    dup[order] = (at_doc[order] != at_doc[first]) | (at[order] != at[first])  # not where a row repeats the same place
    last = order[fresh & (g[order] == group[-1])]
    state = (anchor[-1], (wh[last], at_doc[last], at[last]))
    dup = dup[n_seen:]
    s, e = runs_of(row, dup)
    hit = dup[s] & ~old[row[s]]
    s, e = s[hit], e[hit]
    r = row[s]
    return pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(part[r]), edges(s + shift[r], e + shift[r])], ["doc_id", "part", "flags"]), state


def _clean(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, t, flags in zip(pdf.doc_id, pdf.text, pdf["flags"], strict=True):
                words = split_words(t)
                gone = np.zeros(len(words) + 1, np.int32)
                for f in flags if flags is not None else ():
                    edges = np.frombuffer(f, "<i4").reshape(-1, 2)
                    np.add.at(gone, edges[:, 0], 1)
                    np.add.at(gone, edges[:, 1] + window - 1, -1)
                keep = np.cumsum(gone)[:-1] == 0
                kept = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k) if flags is not None else b" ".join(words)
                rows.append((d, len(words), int(len(words) - keep.sum()), kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return run


class FingerprintLog:
    """Sorted immutable runs of window fingerprints in a shared folder, merged into one beyond ``max_runs``."""

    def __init__(self, spark: SparkSession, window: int = 20, max_runs: int = 4):
        if window < ANCHOR_WORDS:
            raise ValueError(f"a window has at least {ANCHOR_WORDS} words")
        self.spark, self.window, self.max_runs, self.runs = spark, window, max_runs, []
        self.written: list[DataFrame] = []

    def match(self, docs: DataFrame, last: bool = False) -> DataFrame:
        """(doc_id, part, flags) for a batch of (doc_id, part, text) whose ids are all above those of earlier batches; the batch
        becomes a run.

        flags: ranges of window starts that came before; write them before the next call.  last: no batch follows, so no
        run is written.
        """
        if len(self.runs) > self.max_runs:
            self.compact()
        every = docs.where("doc_id is not null").mapInArrow(_fingerprints(self.window), ROW_SCHEMA).withColumn("old", F.lit(False))
        for run in self.runs:
            every = every.unionByName(run.withColumn("flags", F.lit(None).cast("binary")).withColumn("old", F.lit(True)))
        dealt = every.repartition(F.coalesce("anchor", F.xxhash64("doc_id"))).sortWithinPartitions("anchor", F.desc("old"), "doc_id", "start", "part")
        out = dealt.mapInArrow(_merge(not last), ROW_SCHEMA)
        if not last:  # what a task writes is in order of the anchor
            out = materialize(out, "run", free=True)
            self.written.append(out)
            self.runs.append(out.where("anchor is not null").drop("flags"))
        return out.where("flags is not null").select("doc_id", "part", "flags")

    def close(self) -> None:
        """Deletes the runs; an index that is to be kept is not closed."""
        for run in self.written:
            drop(run)
        self.runs, self.written = [], []

    def compact(self) -> None:
        """All runs merged into one sorted run."""
        every = self.runs[0]
        for run in self.runs[1:]:
            every = every.unionByName(run)
        old = self.written
        out = materialize(every.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start", "part"), "run", free=True)
        self.runs, self.written = [out], [out]
        for run in old:
            drop(run)


def numbered(docs: DataFrame) -> DataFrame:
    """``part``: 0, or for texts that share an id their number, by a hash; rows equal in id and text have the same."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"))
    shared = rows.where("doc_id is not null").groupBy("doc_id").agg((F.min("h") != F.max("h")).alias("several")).where("several").select("doc_id")
    if shared.isEmpty():
        return docs.withColumn("part", F.lit(0))
    texts = rows.join(shared, "doc_id", "left_semi").distinct()
    parts = materialize(texts.withColumn("part", F.row_number().over(Window.partitionBy("doc_id").orderBy("h"))), "parts")
    return docs.withColumn("h", F.xxhash64("text")).join(parts, ["doc_id", "h"], "left").drop("h").withColumn("part", F.coalesce("part", F.lit(0)))


def substring_dedup(docs: DataFrame, window: int = 20, batches: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256): each word covered by a window that starts earlier is removed.

    Earlier: in a document with a smaller id, or before in the same one; judged on the input.  Documents are taken in
    ``batches`` ranges of the id.  Null or empty texts have no words.  Rows that repeat an id are one document: a window that
    starts at the same place in several of them is no repeat, so none of them loses it.  A row with a null id keeps all its
    words.  An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = numbered(as_text(docs, id_col, text_col))
    log, flags = FingerprintLog(spark, window), None
    lo = None
    cuts = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    for i, hi in enumerate([*sorted(set(cuts)), None]):
        part = docs if lo is None else docs.where(F.col("doc_id") > int(lo))
        part = part if hi is None else part.where(F.col("doc_id") <= int(hi))
        got, lo = log.match(part, last=hi is None), hi
        got = materialize(got, "flags", free=True)
        flags = got if flags is None else flags.unionByName(got)
    log.close()
    collect_garbage(spark)
    per_doc = flags.groupBy("doc_id", "part").agg(F.collect_list("flags").alias("flags"))
    return docs.join(per_doc, ["doc_id", "part"], "left").mapInPandas(_clean(window), "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
