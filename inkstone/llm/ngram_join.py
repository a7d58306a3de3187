"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Which documents meet: a document's shingles are dealt by hash into as many parts as the size allows differences plus
one, so two sets at or above the threshold have at least one part in common (pigeonhole; exact, no sampling).  Documents
of such a part meet in a block keyed by the smallest set of the part.  Counts of shingles by hash bucket, a few bytes a
document, bound every overlap from above, so members of a block without a possible partner leave it before any set is
sent.  Within a block, inverted lists from shingle to members are searched for those in at least T lists: the short lists
are heap-merged with skips, the long ones binary-probed.  Equal sets are one class beforehand, so copies never expand
into pairs; blocks of one component are not searched twice.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, as_text, distinct, drop, gram_hashes, grouped, join_with_hot_keys, materialize, mix64, signed, split_words, tune, word_hashes
from .components import connected_components

#: Shingles of a block at most, but for a block of one pair of documents that are longer.
BLOCK_SHINGLES = 1_000_000
#: The weight of a binary probe against a step of the merge in the DivideSkip rule for the number of long lists: probes
#: are vectorised, steps of the heap are not.
MU = 0.02
#: Entries of short lists that a heap merges (more are merged by counting); long lists that are probed at once.
HEAP_ENTRIES, PROBES = 4096, 64
#: Sizes of a class differ by this factor at most.
CLASS_RATIO = 2.0
#: Members of a divided block that are in each of its parts, so that the parts of a group of near copies hang together.
PIVOTS = 4
#: Sets of an Arrow batch that share a signature: from so many on, one of them speaks for all.
CROWD = 16
BLOCK_SCHEMA = "center long, block int, node long, label long, asks_only boolean"


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text; with fewer than k words the sequence is the one shingle."""
    words = split_words(text, lower=True)
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    return distinct(gram_hashes(h, min(k, len(h))))


def packed(u: np.ndarray) -> bytes:
    return u.astype("<u8").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def bucket_counts(u: np.ndarray) -> bytes:
    """How many shingles have each value of their first few bits: two to four a bucket, a byte each.

    The sum over buckets of the smaller count is at least the overlap of two sets.  Neighbouring buckets add up to those of
    half as many.  A set with a count beyond a byte gives no counts and is never ruled out.
    """
    bits = max(3, len(u).bit_length() - 2)
    n = np.bincount((u >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return n.astype(np.uint8).tobytes() if n.max() <= 255 else b""


def set_hash(u: np.ndarray) -> int:
    """64 bits that depend on the set alone, as Spark's long."""
    return int(np.add.reduce(mix64(u)).astype(np.int64))


def size_classes(n: int, percent: int) -> list[tuple[int, int]]:
    """(class, its largest size) for the classes in which a set of n shingles has to look for partners.

    Classes are [2^c, 2^(c+1)).  A pair meets in the class of its larger set.
    """
    first = int(math.floor(math.log(n, CLASS_RATIO) + 1e-9))
    last = int(math.floor(math.log(n * 100 // percent, CLASS_RATIO) + 1e-9))
    return [(c, math.ceil(CLASS_RATIO ** (c + 1)) - 1) for c in range(first, last + 1)]


def part_count(largest: int, percent: int) -> int:
    """Differences that a pair of sets of at most this size can have at the threshold, plus one."""
    return 2 * largest * (100 - percent) // (100 + percent) + 1


def part_signatures(u: np.ndarray, percent: int) -> np.ndarray:
    """One 64-bit signature for every non-empty part, in each class; the class and the part's number are in it.

    A set whose non-empty parts are no more than the differences that it allows could have nothing but empty parts in
    common with such another set; both then also give each shingle of their prefix (prefix filter), which is exact too.
    """
    out, n = [], len(u)
    for c, largest in size_classes(len(u), percent):
        m = part_count(largest, percent)
        part = ((u >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # monotone in u, so parts are runs of the sorted set
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sums = np.add.reduceat(mix64(u ^ STEP), starts)
        out.append(mix64(sums + part[starts] * STEP + mix64(np.uint64([c + 1]))))
        if len(starts) <= (n + min(largest, n * 100 // percent)) * (100 - percent) // (100 + percent):
            out.append(mix64(u[: n - -(-percent * n // 100) + 1] * STEP))
    return np.concatenate(out)


def heap_merge(lists: list[list[int]], need: int) -> dict[int, int]:
    """Id and count of the ids in at least ``need`` of the sorted lists: a heap of list heads, which leaps over ids that
    can't reach it."""
    heap = [(lst[0], i) for i, lst in enumerate(lists) if lst]
    heapq.heapify(heap)
    at, found = [0] * len(lists), {}
    while len(heap) >= need:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        target = top + 1
        if len(popped) >= need:
            found[top] = len(popped)
        else:
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            target = heap[0][0]
        for i in popped:
            at[i] = k = bisect_left(lists[i], target, at[i])
            if k < len(lists[i]):
                heapq.heappush(heap, (lists[i][k], i))
    return found


class BlockIndex:
    """Inverted lists from shingle to the members of a block, one after the other; ``keys`` is list number * members +
    member and so sorted throughout."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sizes, self.percent, self.members = np.array([len(s) for s in sets], np.int64), percent, max(1, len(sets))
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")  # owners stay in order within a shingle
        flat, self.owner = flat[order], owner[order]
        fresh = np.ones(len(flat), bool)
        np.not_equal(flat[1:], flat[:-1], out=fresh[1:])
        self.starts = np.flatnonzero(fresh)
        self.tokens = flat[self.starts]
        self.lengths = np.diff(np.append(self.starts, len(flat)))
        self.keys = (np.cumsum(fresh) - 1) * self.members + self.owner

    def divide_skip(self, lists: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(members, counts) of the members in at least t of the given lists.

        The L longest lists are left out of the merge, so a member needs t - L there; only such members are looked for in
        the long lists, by binary search, as long as they can still reach t.  Short lists are merged with a heap, unless
        they have so many entries that counting all of them takes less time.
        """
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if t <= 0 or len(lists) < t:
            return none
        lengths = self.lengths[lists]
        order = np.argsort(lengths, kind="stable")
        lists, lengths = lists[order], lengths[order]
        n_long = min(t - 1, int(t / (MU * math.log2(int(lengths[-1]) + 1) + 1)))
        short, need = lists[: len(lists) - n_long], t - n_long
        starts, sizes = self.starts[short], lengths[: len(short)]
        if (total := int(sizes.sum())) <= HEAP_ENTRIES:
            found = heap_merge([self.owner[s : s + n].tolist() for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)], need)
            ids, counts = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
        else:
            at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
            merged = np.bincount(self.owner[at])
            ids = np.flatnonzero(merged >= need)
            counts = merged[ids]
        for i in range(len(short), len(lists), PROBES):
            if not len(ids):
                return none
            probes = lists[i : i + PROBES, None] * self.members + ids
            k = np.minimum(np.searchsorted(self.keys, probes), len(self.keys) - 1)
            counts = counts + (self.keys[k] == probes).sum(0)
            can = counts + max(0, len(lists) - i - PROBES) >= t
            ids, counts = ids[can], counts[can]
        return ids, counts

    def search(self, q: np.ndarray, least_list: int = 2) -> list[int]:
        """Members whose Jaccard similarity with the sorted set q reaches the threshold.

        least_list: 2 if q is a member itself, whose lists of one hold nobody else.
        """
        if not len(q) or not len(self.tokens):
            return []
        k = np.minimum(np.searchsorted(self.tokens, q), len(self.tokens) - 1)
        k = k[(self.tokens[k] == q) & (self.lengths[k] >= least_list)]
        members, common = self.divide_skip(k, -(-self.percent * len(q) // 100))  # a partner shares at least this many
        ok = 100 * common >= self.percent * (len(q) + self.sizes[members] - common)  # the counts are whole overlaps
        return members[ok].tolist()


def block_links(ids: list[int], sets: list[np.ndarray], percent: int, labels: list | None = None) -> list[tuple[int, int]]:
    """Links that join the members of a block as all its links would.

    labels: members with the same one are joined already.  A pair is settled once either member was a query, or both are
    joined.  Queries come from the component with the fewest members that were none yet; when one component alone has such
    members, all pairs are settled.  So in a group of near copies a few queries do.
    """
    index, root = BlockIndex(sets, percent), list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    first: dict = {}
    if labels is not None:
        root = [first.setdefault(label, i) for i, label in enumerate(labels)]
    waiting, links = {}, []  # by component, the members that were no query yet
    for i in range(len(ids)):
        waiting.setdefault(root[i], []).append(i)
    heap = [(len(members), r) for r, members in waiting.items()]
    heapq.heapify(heap)
    while len(waiting) > 1:
        size, r = heapq.heappop(heap)
        if r not in waiting or len(waiting[r]) != size:
            continue
        q = waiting[r].pop()
        for m in index.search(sets[q]):
            a, b = find(q), find(m)
            if a != b:
                x, y = waiting.pop(a, []), waiting.pop(b, [])
                if len(x) < len(y):
                    a, b, x, y = b, a, y, x
                root[b] = a
                x.extend(y)
                waiting[a] = x
                links.append((ids[q], ids[m]))
        r = find(q)
        if waiting[r]:
            heapq.heappush(heap, (len(waiting[r]), r))
        else:
            del waiting[r]
    return links


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of n and m shingles at the threshold."""
    return -(-percent * (n + m) // (100 + percent))


def promising(sizes: np.ndarray, counts: list[bytes], percent: int, labels: np.ndarray | None = None, guests: np.ndarray | None = None) -> np.ndarray:
    """Which members of a block have a member that their counts don't rule out, of another label if there are labels.

    guests: members that aren't compared with each other.
    """
    out, width = np.zeros(len(sizes), bool), np.array([len(c) for c in counts])
    groups = {w: np.flatnonzero(width == w) for w in np.unique(width[width > 0]).tolist()}
    tables = {w: np.stack([np.frombuffer(counts[i], np.uint8) for i in at.tolist()]) for w, at in groups.items()}

    def compare(at: np.ndarray, x: np.ndarray | None, other: np.ndarray, y: np.ndarray | None) -> None:
        step = max(1, 4_000_000 // max(1, len(other) if y is None else y.size))
        for k in range(0, len(at), step):
            own = at[k : k + step]
            n, m = sizes[own][:, None], sizes[other]
            ok = (own[:, None] != other) & (100 * n >= percent * m) & (100 * m >= percent * n) & ~(out[own][:, None] & out[other])
            if labels is not None:
                ok &= labels[own][:, None] != labels[other]
            if guests is not None:
                ok &= ~(guests[own][:, None] & guests[other])
            i, j = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
            if not len(i):
                continue
            ok = ok[np.ix_(i, j)]
            if x is not None:
                ok &= np.minimum(x[k + i, None], y[j]).sum(2, dtype=np.int64) >= needed(n[i], m[j], percent)
            out[own[i]] |= ok.any(1)
            out[other[j]] |= ok.any(0)

    for w, at in groups.items():
        compare(at, tables[w], at, tables[w])
        for v in groups:  # the counts of larger sets, halved until they are as many
            if w < v <= 2 * w * 100 / percent:
                compare(at, tables[w].astype(np.uint16), groups[v], tables[v].reshape(-1, w, v // w).sum(2, dtype=np.uint16))
    if len(unruly := np.flatnonzero(width == 0)):
        compare(unruly, None, np.arange(len(sizes)), None)
    return out


def _search_block(percent: int):
    """Links within a block; where it is a part of a larger one, members that ask from other parts come along."""

    def search(block: dict[str, np.ndarray]) -> list[np.ndarray]:
        at = first_rows(block)
        sets, label, guest = [unpacked(x) for x in block["shingles"][at]], block["label"][at], block["asks_only"][at].astype(bool)
        ids, members = block["node"][at].tolist(), np.flatnonzero(~guest).tolist()
        links = block_links([ids[i] for i in members], [sets[i] for i in members], percent, label[members].tolist())
        if len(members) < len(ids) and members:
            index = BlockIndex([sets[i] for i in members], percent)
            for i in np.flatnonzero(guest).tolist():
                links += [(ids[i], ids[members[m]]) for m in index.search(sets[i], 1) if label[members[m]] != label[i]]
        got = np.array(links, np.int64).reshape(-1, 2)
        return [got[:, 0], got[:, 1]]

    return search


def first_rows(block: dict[str, np.ndarray]) -> np.ndarray:
    """One row per member, as a member rather than a guest."""
    order = np.lexsort((block["asks_only"], block["node"]))
    node = block["node"][order]
    return order[np.r_[True, node[1:] != node[:-1]]]


def _filter_block(percent: int):
    """Members of a block that may have a partner of another label in it."""

    def run(block: dict[str, np.ndarray]) -> list[np.ndarray]:
        at = first_rows(block)
        keep = at[promising(block["n_shingles"][at], block["counts"][at].tolist(), percent, block["label"][at], block["asks_only"][at].astype(bool))]
        return [block[c][keep] for c in ("center", "block", "node", "label", "asks_only")]

    return run


def _sketch(k: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column("text").to_pylist():
                u = shingles(t, k)
                b = np.bitwise_xor.reduce(mix64(u * STEP))
                rows.append((len(u), set_hash(u), int(b.astype(np.int64)), bucket_counts(u) if len(u) else None))
            n, s1, s2, counts = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(counts, pa.binary())], ["doc_id", "text_hash", "n_shingles", "s1", "s2", "counts"])

    return sketch


def stars(sig: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, center of each row, whether its signature has more than one set) of rows sorted by signature and set."""
    starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(sig)])
    return starts, np.repeat(s[starts], sizes), np.repeat(s[starts] != s[starts + sizes - 1] if len(starts) else [], sizes).astype(bool)


def smallest_connected(members: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """For each of n numbers the smallest that it is connected with by groups of ``sizes``, one after another in ``members``."""
    label, starts = np.arange(n), np.cumsum(sizes) - sizes
    while True:
        new = label.copy()
        np.minimum.at(new, members, np.repeat(np.minimum.reduceat(label[members], starts), sizes))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _signatures(k: int, percent: int, crowd_of: int):
    """(sig, s1, near) of each batch: a row per signature and set.  Sets of which ``crowd_of`` share a signature are connected, and
    of each such group its smallest set speaks for all in that signature, with rows (smallest, set, near) beside it.  So a
    signature that very many documents have is a row or a few in each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {}
            for t in batch.column("text").to_pylist():
                u = shingles(t, k)
                if len(u):
                    sets.setdefault(set_hash(u), u)
            if not sets:
                continue
            sigs = [signed(part_signatures(u, percent)) for u in sets.values()]
            sig, s = np.concatenate(sigs), np.repeat(np.fromiter(sets, np.int64, len(sets)), [len(x) for x in sigs])
            order = np.lexsort((s, sig))
            sig, s = sig[order], s[order]
            starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            sizes = np.diff(np.r_[starts, len(sig)])
            crowd = np.repeat(sizes >= crowd_of, sizes)
            near = np.empty((0, 2), np.int64)
            if crowd.any():
                all_, at = np.unique(s[crowd], return_inverse=True)
                first = smallest_connected(at, sizes[sizes >= crowd_of], len(all_))
                near = np.stack([all_[first], all_], 1)
                spoken = np.unique(np.stack([sig[crowd], all_[first][at]], 1), axis=0)
                sig, s = np.r_[sig[~crowd], spoken[:, 0]], np.r_[s[~crowd], spoken[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[sig, near[:, 0]]), pa.array(np.r_[s, near[:, 1]]), pa.array(np.r_[np.zeros(len(sig), bool), np.ones(len(near), bool)])], ["sig", "s1", "near"])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(center, s1, near) from rows sorted by near, sig and s1, as a stream: the last signature is all that is held."""
    last, center, told = None, 0, False
    for batch in batches:
        near = batch.column("near").to_numpy(zero_copy_only=False)
        sig, s = batch.column("sig").to_numpy(), batch.column("s1").to_numpy()
        rows = [np.unique(np.stack([sig[near], s[near]], 1), axis=0)] if near.any() else []
        n_near = len(rows[0]) if rows else 0
        sig, s = sig[~near], s[~near]
        if len(sig):
            head = 0
            if last is not None and sig[0] == last:  # the signature goes on from the batch before
                head = int(np.searchsorted(sig != last, True)) if (sig != last).any() else len(sig)
                own = np.unique(s[:head][s[:head] != center])
                if len(own):
                    rows.append(np.stack([np.full(len(own), center), own], 1))
                    if not told:
                        rows.append(np.array([[center, center]]))
                        told = True
            if head < len(sig):
                rest_sig, rest = sig[head:], s[head:]
                starts, of, shared = stars(rest_sig, rest)
                rows.append(np.unique(np.stack([of[shared], rest[shared]], 1), axis=0))
                last, center, told = rest_sig[-1], int(rest[starts[-1]]), bool(shared[-1])
        if rows:
            got = np.concatenate(rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1]), pa.array(np.arange(len(got)) < n_near)], ["center", "s1", "near"])


def _sets(k: int):
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for node, n, s1, t in zip(pdf.node, pdf.n_shingles, pdf.s1, pdf.text, strict=True):
                u = shingles(t, k)
                if len(u) == n and set_hash(u) == s1:  # another text under a repeated id is another set
                    rows.append((node, packed(u)))
            yield pd.DataFrame(rows, columns=["node", "shingles"])

    return sets


def _blocks(met: DataFrame, block_shingles: int, every: bool, most: int) -> DataFrame:
    """(center, block, node, n_shingles, counts, label, asks_only) of (center, s1, node, n_shingles, counts, label).

    A center with too many shingles is divided by hash; PIVOTS of its members, by hash too, are in each part.  every: its
    members that aren't of its pivot's label ask in all parts, so no pair is lost.  most: the number of centers at most.
    """
    per = met.groupBy("center").agg(F.ceil(F.sum("n_shingles") / block_shingles).cast("int").alias("n_blocks"), (F.min("label") != F.max("label")).alias("mixed"))
    per = materialize(per.where("mixed").drop("mixed"), "centers", most=most)
    cols = ["center", "block", "node", "n_shingles", "counts", "label", "asks_only"]
    out = met.join(per, "center").withColumn("block", F.pmod(F.xxhash64("node"), "n_blocks").cast("int")).withColumn("asks_only", F.lit(False)).select(*cols)
    large = per.where("n_blocks > 1")
    if large.isEmpty():
        return out
    dealt = met.join(large, "center")
    pivots = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "node", "n_shingles", "counts", "label")).alias(f"p{i}") for i in range(PIVOTS)]
    held = materialize(dealt.groupBy("center", "n_blocks").agg(*pivots), "pivots", most=most)
    parts = lambda df: df.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    if every:
        guests = dealt.join(held.select("center", F.col("p0.label").alias("main")), "center").where("label <> main")
        return out.unionByName(parts(guests).withColumn("asks_only", F.lit(True)).select(*cols))
    each = parts(held.select("center", "n_blocks", F.explode(F.array(*[F.col(f"p{i}") for i in range(PIVOTS)])).alias("p")))
    return out.unionByName(each.select("center", "block", "p.node", "p.n_shingles", "p.counts", "p.label", F.lit(False).alias("asks_only")))


def _joined(docs: DataFrame, k: int, percent: int, block_shingles: int) -> tuple[DataFrame, int]:
    """(doc_id, text_hash, n_shingles, class_id, component, component_id) of each row of (doc_id, text), and their number.

    component is a number of the component's own, null for empty sets and rows without an id.
    """
    tune(docs.sparkSession)
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    sketch = materialize(hashed.mapInArrow(_sketch(k), "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, counts binary"), "sketch")
    rows = sketch.count()
    real = sketch.where("doc_id is not null and n_shingles > 0")
    key = ["n_shingles", "s1", "s2"]
    classes = real.groupBy(*key).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.min("counts").alias("counts"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes", most=rows)  # numbered once, when written

    sigs = docs.where("doc_id is not null and text is not null").select("text").mapInArrow(_signatures(k, percent, CROWD), "sig long, s1 long, near boolean")
    seen = sigs.repartition("sig").sortWithinPartitions("near", "sig", "s1").mapInArrow(_meet, "center long, s1 long, near boolean")
    seen = materialize(seen, "seen", free=True)
    local, over = (seen.where(F.col("near") == x).select("center", "s1").distinct() for x in (True, False))
    # sets that another spoke for also meet where that one does
    through = local.join(over.where("center <> s1").select(F.col("center").alias("c"), F.col("s1").alias("center")), "center").select(F.col("c").alias("center"), "s1")
    met = local.unionByName(over).unionByName(through).distinct().join(classes.select("s1", "node", "n_shingles", "counts"), "s1")
    met = materialize(met.withColumn("label", F.col("node")), "met", free=True)
    drop(seen)

    # members without a possible partner leave; those of blocks that will be divided all stay for now
    divided = materialize(met.groupBy("center").agg(F.sum("n_shingles").alias("n")).where(F.col("n") > block_shingles).select("center"), "divided", most=rows)
    whole = _blocks(met.join(divided, "center", "left_anti"), block_shingles, every=False, most=rows)
    left = grouped(whole, ["center", "block"], _filter_block(percent), BLOCK_SCHEMA).select("center", "node")
    near = materialize(left.unionByName(met.join(divided, "center", "left_semi").select("center", "node")), "near", free=True)
    wanted = near.select("node").distinct().join(classes, "node").select(F.col("class_id").alias("doc_id"), "node", "n_shingles", "s1")
    sets = docs.where("text is not null").join(wanted, "doc_id").mapInPandas(_sets(k), "node long, shingles binary")
    if not real.groupBy("doc_id").count().where("count > 1").isEmpty():
        sets = sets.dropDuplicates(["node"])  # rows that repeat id and text
    sets = materialize(sets, "sets", free=True)

    def linked(members: DataFrame) -> DataFrame:
        cols = members.select("center", "block", "node", "label", "asks_only")
        return materialize(grouped(cols.join(sets, "node"), ["center", "block"], _search_block(percent), "src long, dst long"), "links", free=True)

    # first each set in one block only, then all blocks that still hold more than one component
    met_near = met.join(near, ["center", "node"], "left_semi")
    home = met_near.groupBy("node").agg(F.min("center").alias("center"))
    links = linked(_blocks(met_near.join(home, ["center", "node"], "left_semi").unionByName(met_near.where("center = s1")).distinct(), block_shingles, every=False, most=rows).distinct())
    comps = connected_components(links)
    labelled = met_near.drop("label").join(comps.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    again = grouped(_blocks(materialize(labelled, "labelled"), block_shingles, every=True, most=rows), ["center", "block"], _filter_block(percent), BLOCK_SCHEMA)
    more = linked(materialize(again, "again", free=True))
    if not more.isEmpty():
        comps = connected_components(comps.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(more))
    comps = materialize(comps, "components", most=rows)

    least = comps.join(classes.select("node", "class_id"), "node").groupBy("component").agg(F.min("class_id").alias("component_id"), F.count("*").alias("uses"))
    named = materialize(join_with_hot_keys(comps, materialize(least, "least", most=rows), ["component"], "uses", rows).drop("uses"), "named", most=rows)
    classes = materialize(classes.drop("counts").join(named, "node", "left").withColumn("component", F.coalesce("component", "node")).withColumn("component_id", F.coalesce("component_id", "class_id")), "of_class", most=rows)
    return join_with_hot_keys(real.select("doc_id", "text_hash", *key), classes, key, "copies", rows).drop("copies", "node", "s1", "s2").unionByName(
        sketch.where("not (doc_id is not null and n_shingles > 0)").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("class_id"), F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    ), rows


def ngram_jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id): components of documents linked at Jaccard >= percent / 100.

    Texts are lower-cased (A-Z) and split into words ``[^\\x20\\x09-\\x0D]+``; a set is the distinct k-word shingles of
    the whole text, or the whole sequence if it is shorter.  Null and empty texts have an empty set and link with
    nothing.  class_id is the smallest id with the same set.  A row with a null id gets its n_shingles and null ids.
    Repeated rows, and rows that repeat an id with another text, each get their row.  An empty table gives none.  Other
    columns are not read.
    """
    return _joined(as_text(docs, id_col, text_col), k, percent, block_shingles)[0].select("doc_id", "n_shingles", "component_id", "class_id")


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id.

    Rows go one by one: another text under the id of a row that goes stays.  Of rows of a component with one id the one
    with the smallest 64-bit hash of its text stays, and of rows equal in id and text any one.  Rows with a null id, and
    those without words, stay.  An empty table gives no rows.
    """
    found = materialize(_joined(as_text(docs, "doc_id", "text"), k, percent, BLOCK_SHINGLES)[0].where("component is not null"), "joined")
    first = found.where("doc_id = component_id")
    several = first.groupBy("component").agg(F.min("text_hash").alias("stays"), F.count("*").alias("n")).where("n > 1")
    losers = first.join(several, "component").select("doc_id", "text_hash", (F.col("text_hash") == F.col("stays")).alias("twin"))
    gone = found.where("doc_id <> component_id").select("doc_id", "text_hash", F.lit(False).alias("twin")).unionByName(losers).distinct()
    gone = gone.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("twin").alias("_twin"))
    rows = docs.withColumn("_text_hash", F.xxhash64(F.col("text").cast("string")))
    match = (F.col("doc_id").cast("long") == F.col("_d")) & (F.col("_text_hash") == F.col("_h"))
    out = rows.join(gone, match, "left_anti")
    twins = gone.where("_twin")
    if not twins.isEmpty():  # one row of those that repeat id and text
        out = out.unionByName(rows.join(twins, match, "left_semi").dropDuplicates(["doc_id", "_text_hash"]))
    return out.select(*docs.columns)
