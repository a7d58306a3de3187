"""The operators on pairs, against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from inkstone.llm import embedding_graph, ngram_join, substring_dedup
from inkstone.llm.components import connected_components

from .helpers import corpus, edited, frame, prose, union_find, words


def shingle_set(text, k):
    w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    return set() if not w else {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def brute_components(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows if i is not None}
    ids = sorted(sets)
    find = union_find([(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])])
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 90, 1_000_000), (5, 80, 300)])
def test_ngram_join_is_brute_force(spark, k, percent, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "CROWD", 3 if block == 300 else ngram_join.CROWD)
    rng = random.Random(7)
    rows = corpus()
    base = prose(rng, 120)
    rows += [(1000 + i, edited(rng, base, i % 5)) for i in range(40)]  # a large group, split into blocks
    extra = [(None, "a b c d"), (2000, "two texts under an id"), (2000, "have a row each"), (2001, base), (2001, base)]
    got = ngram_join.ngram_jaccard_join(frame(spark, [*rows, *extra]), k, percent, block_shingles=block).collect()
    assert len(got) == len(rows) + len(extra)
    want = brute_components([*rows, extra[-1]], k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id not in (None, 2000)} == want
    assert len({(r.n_shingles, r.component_id) for r in got if r.doc_id == 2000}) == 2 - (k > 4)
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_ngram_join_of_nothing(spark):
    assert ngram_join.ngram_jaccard_join(frame(spark, [(1, "a b")]).limit(0)).collect() == []


def test_keep_one_of_each(spark):
    kept = ngram_join.keep_one_of_each(frame(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "q r s"), (None, "a b c d e f g"), (4, None)]))
    assert sorted(((r.doc_id is not None, r.doc_id) for r in kept.collect()), key=str) == sorted([(True, 1), (True, 3), (True, 4), (False, None)], key=str)
    assert "anchor" in kept.columns


def test_rows_of_copies_go_one_by_one(spark):
    """A text under the id of a row that goes stays, and of rows equal in id and text one does."""
    t, u = "a b c d e f g", "h i j k l m n"
    rows = [(1, t), (1, t), (2, t), (2, u), (3, "q r s"), (3, "t u v"), (4, None), (4, None), (5, "x"), (5, "x"), (None, t)]
    kept = ngram_join.keep_one_of_each(frame(spark, rows)).select("doc_id", "text").collect()
    want = [(1, t), (2, u), (3, "q r s"), (3, "t u v"), (4, None), (4, None), (5, "x"), (None, t)]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)
    assert ngram_join.keep_one_of_each(frame(spark, rows).limit(0)).collect() == []


def test_counts_rule_out_no_pair():
    rng = np.random.default_rng(6)
    for percent in (50, 80, 90):
        sets = []
        for n in (1, 2, 5, 30, 31, 63, 64, 100, 127, 128, 500):
            x = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
            for _ in range(4):
                sets.append(np.unique(np.where(rng.random(n) < 0.08, rng.integers(0, 2**63, n).astype(np.uint64), x)))
        got = ngram_join.promising(np.array([len(s) for s in sets]), [ngram_join.bucket_counts(s) if i % 9 else b"" for i, s in enumerate(sets)], percent)
        near = [any(a is not b and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)) for b in sets) for a in sets]
        assert all(got[i] for i, x in enumerate(near) if x)


def test_t_occurrence_search():
    rng = np.random.default_rng(5)
    for n, universe in ((3, 20), (40, 60), (300, 80)):
        sets = [np.unique(rng.integers(0, universe, rng.integers(1, universe))) for _ in range(n)]
        index = ngram_join.BlockIndex(sets, 60)
        for q in range(0, n, 7):
            want = [m for m in range(n) if m != q and 100 * len(np.intersect1d(sets[q], sets[m])) >= 60 * len(np.union1d(sets[q], sets[m]))]
            assert [m for m in sorted(index.search(sets[q], 1)) if m != q] == want
        lists = [sorted(rng.choice(50, rng.integers(1, 9), replace=False).tolist()) for _ in range(12)]
        count = Counter(x for lst in lists for x in lst)
        for need in (1, 2, 4):
            assert ngram_join.heap_merge(lists, need) == {x: c for x, c in sorted(count.items()) if c >= need}


def test_part_signatures_lose_no_pair():
    """Pairs exactly at the threshold share a signature, for small sets too."""
    rng = np.random.default_rng(9)
    for percent in (80, 90):
        for n in (*range(1, 40), 60, 63, 100, 127):
            for _ in range(6):
                x = rng.integers(0, 2**63, n).astype(np.uint64)
                d = 0
                while 100 * (n - d - 1) >= percent * (n + d + 1):
                    d += 1
                y = np.concatenate([x[d:], rng.integers(0, 2**63, d).astype(np.uint64)])
                a, b = (set(ngram_join.part_signatures(np.unique(v), percent).tolist()) for v in (x, y))
                assert a & b, (percent, n, d)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 5), (200, 201), (7, 7), (200, 201)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 0, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def brute_substrings(rows, window):
    """By row: the words of windows whose sequence starts earlier, in a smaller id or before in the same."""
    first, out = {}, []
    split = [(i, words(t)) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (i, s)), (i, s))
    for i, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                gone[s : s + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("batches", "window"), [(1, 20), (7, 20), (2, 6)])
def test_substring_dedup_is_brute_force(spark, batches, window):
    rng = random.Random(4)
    rows = corpus(11) + [(900, "a b " * 60), (901, prose(rng, 30, 3)), (902, prose(rng, 200, 2))]
    t = prose(rng, 30)
    rows += [(950, t), (950, t), (951, t), (951, "q " + t), (951, t + " r s"), (952, t[:-9])]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(frame(spark, rows), window, batches).collect())
    assert got == brute_substrings(rows, window)


def test_rows_that_repeat_an_id_keep_their_text(spark):
    t = " ".join(f"x{i}" for i in range(30))
    got = substring_dedup.substring_dedup(frame(spark, [(0, t), (0, t), (2, t)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(0, 0), (0, 0), (2, 30)]


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.substring_dedup(frame(spark, [(1, "a")]).limit(0), batches=2).collect() == []
    (row,) = substring_dedup.substring_dedup(frame(spark, [(None, "a b " * 30)])).collect()
    assert (row.doc_id, row.n_words, row.n_removed) == (None, 60, 0)


def test_embedding_links_are_brute_force(spark):
    rng, rows = np.random.default_rng(2), []
    centres = rng.normal(size=(30, 16))
    for i in range(500):
        rows.append((i, (centres[i % 30] + 0.12 * rng.normal(size=16)).astype(np.float32).tolist()))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, None), (503, [0.0] * 16), (504, [float("nan")] * 16), (505, [None] * 16), (506, []), (507, [2 * x for x in rows[3][1]])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, shard string, rep int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_graph.embedding_near_dedup(df).collect()}
    good = {i: np.array(v, float) for i, v in rows if v and None not in v and all(map(math.isfinite, v)) and any(v)}
    ids = sorted(good)
    x = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    links = {ids[i]: int(near[i].sum()) for i in range(len(ids))}
    found = sum(got[i][0] for i in ids)
    assert found >= 0.9 * sum(links.values()) > 0
    assert all(got[i][0] <= links[i] for i in ids)
    assert all(got[i] == (0, i, True) for i in range(502, 507))
    find = union_find([(ids[i], ids[j]) for i, j in zip(*np.nonzero(near), strict=True)])
    assert sum(got[i][1] == find(i) for i in ids) >= 0.95 * len(ids)
    assert embedding_graph.embedding_near_dedup(df.limit(0)).collect() == []


def test_vectors_of_any_length_and_norm(spark):
    rows = [(0, [1e200, 2e200, 0.0]), (1, [2e200, 4e200, 0.0]), (2, [1e-200, 2e-200, 0.0]), (3, [5e-324, 1e-323, 0.0]), (4, [0.0, 0.0, 1.0]), (5, [1.0, 2.0]), (6, [2.0, 4.0]), (7, [1.0]), (8, [1.0, 2.0, 0.0, 0.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding_graph.embedding_near_dedup(df).collect()), key=str)
    want = [(0, 3, 0), (1, 3, 0), (2, 3, 0), (3, 3, 0), (4, 0, 4), (5, 1, 5), (6, 1, 5), (7, 0, 7), (8, 0, 8), (None, 0, None)]
    assert got == sorted(want, key=str)


def test_large_shards_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_graph, "BLOCK", 60)
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    rows = [(i, (base + 0.02 * rng.normal(size=8)).tolist()) for i in range(200)]
    got = embedding_graph.embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sum(r.n_links for r in got) >= 0.9 * 200 * 199
    assert {r.component_id for r in got} == {0}


def test_a_group_of_near_copies_is_found_from_other_blocks(spark, monkeypatch):
    """More of them than a vector has neighbours, so no list leads to them from outside, in blocks of a divided shard."""
    monkeypatch.setattr(embedding_graph, "BLOCK", 300)
    monkeypatch.setattr(embedding_graph, "SHARD", 2_000)
    rng = np.random.default_rng(8)
    base = rng.normal(size=32)
    rows = [(i, (base + 0.02 * rng.normal(size=32) if i < 250 else rng.normal(size=32)).tolist()) for i in range(900)]
    got = embedding_graph.embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), target=0.0).collect()
    assert sorted(r.n_links for r in got) == sorted(linked_by_brute_force(rows, 0.95).tolist())


def test_no_edge_within_reach_is_dropped():
    """Whatever is within the range of a query is within reach of all that the range expands."""
    rng = np.random.default_rng(1)
    for least in (0.5, 0.8, 0.95):
        q = embedding_graph.unit(rng.normal(size=3))
        x = embedding_graph.unit(q + rng.normal(size=(400, 3)))
        expanded, found = x[x @ q >= least - embedding_graph.SLACK], x[x @ q >= least]
        assert (expanded @ found.T >= embedding_graph.reach_of(least) - 1e-9).all()


def vectors_in_pairs(clusters=4, each=300, dims=48):
    """Two near vectors each, in clusters that are so far apart that a graph of nearest neighbours has no way between them."""
    rng = np.random.default_rng(4)
    base = np.repeat(3 * rng.normal(size=(clusters, dims)), each // 2, axis=0) + rng.normal(size=(clusters * each // 2, dims))
    return [(i, v.tolist()) for i, v in enumerate(np.repeat(base, 2, axis=0) + 0.1 * rng.normal(size=(clusters * each, dims)))]


def linked_by_brute_force(rows, least):
    x = embedding_graph.unit(np.array([v for _, v in rows]))
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    return near.sum(1)


def test_links_count_on_both_ends(spark, monkeypatch):
    """A pair that only one direction of the search finds, in blocks that a query enters from the medoid."""
    monkeypatch.setattr(embedding_graph, "BLOCK", 300)
    monkeypatch.setattr(embedding_graph, "SHARD", 2_000)
    rows = vectors_in_pairs()
    assert set(linked_by_brute_force(rows, 0.98)) == {1}
    got = embedding_graph.embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.98, target=0.0).collect()
    size = Counter(r.component_id for r in got)
    assert len(size) < len(rows)
    assert all(r.n_links == size[r.component_id] - 1 for r in got)


def test_audit_sees_losses_beside_copies(spark, monkeypatch):
    """Links of copies, which are never lost, don't hide those that no overlap of shards finds."""
    monkeypatch.setattr(embedding_graph, "BLOCK", 300)
    monkeypatch.setattr(embedding_graph, "SHARD", 2_000)
    rows = vectors_in_pairs(3, 400)
    copies = [(i, [1.0] * 48) for i in range(5000, 5600)]
    got = embedding_graph.embedding_near_dedup(spark.createDataFrame(rows + copies, "vec_id long, embedding array<double>"), 0.98).collect()
    n_links = {r.vec_id: r.n_links for r in got}
    assert [n_links[i] for i, _ in copies] == [599] * 600
    assert sum(n_links[i] for i, _ in rows) >= 0.9 * linked_by_brute_force(rows, 0.98).sum()
