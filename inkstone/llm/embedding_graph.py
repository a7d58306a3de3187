"""Embedding near-dedup over a robust-pruned flat graph.

Vectors are dealt to the nearest few of k-means centres, so shards overlap.  In each shard a flat graph is built with
robust pruning; a vector's adjacency lists from its shards are united.  Each vector is then searched for in the graph of
each of its shards: greedily from the medoids, and from itself, expanding the range to all that are close enough.  Every
pair is verified by cosine in double precision.  Equal vectors are one class beforehand, shards that are too large are
split into blocks that each query visits in turn, and recall is audited against a brute-force scan; where no overlap reaches
the target, all blocks of vectors are compared with each other.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, materialize, tune
from .components import connected_components

#: Vectors of a shard that are aimed at, and members of a block of a shard at most.
SHARD, BLOCK = 1_000, 2_000
#: Shards that a vector is dealt to; neighbours of a vector; the pruning slack; the least queue of a search.
OVERLAP, DEGREE, ALPHA, BEAM = 2, 24, 1.2, 16
#: Vectors on which centres are fitted (a bounded sample by hash), and queries of the audit; linked ones that it needs, else
#: it takes eight times as many.
FIT_SAMPLE, AUDIT, AUDIT_LINKED = 20_000, 512, 32
#: The search goes on through vectors a little beyond the threshold, so that it reaches all within.
SLACK = 0.05


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of norm 1; scaled by their largest component first, so squares neither overflow nor vanish."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def stack(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in col])


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of unit vectors by cosine."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.linalg.norm(sums, axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def robust_prune(near: np.ndarray, dist: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of candidates by distance, those that no kept one is alpha times closer to; at most ``degree``.

    near: candidates in order; dist: their distances to the node at [0, :] and among themselves below.
    """
    kept, alive = [], np.ones(len(near), bool)
    for i in range(len(near)):
        if not alive[i]:
            continue
        kept.append(near[i])
        if len(kept) == degree:
            break
        alive &= alpha * dist[1 + i] > dist[0]
    return np.array(kept, np.int64)


def build_graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, pool: int = 64) -> list[np.ndarray]:
    """Adjacency lists of a shard: the nearest of each, robust-pruned, with the reverse edges pruned in."""
    n = len(x)
    if n <= 1:
        return [np.empty(0, np.int64) for _ in range(n)]
    pool = min(pool, n - 1)
    cand: list[np.ndarray] = []
    for i in range(0, n, 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        top = np.argpartition(-s, pool - 1, axis=1)[:, :pool]
        cand.extend(top)

    def pruned(i: int, c: np.ndarray) -> np.ndarray:
        y = x[c]
        d = 1 - y @ x[i]
        o = np.lexsort((c, d))
        c, y, d = c[o], y[o], d[o]
        return robust_prune(c, np.vstack([d, 1 - y @ y.T]), degree, alpha)

    out = [pruned(i, c) for i, c in enumerate(cand)]
    back: list[list[int]] = [[] for _ in range(n)]
    for i, c in enumerate(out):
        for j in c.tolist():
            back[j].append(i)
    for i in range(n):
        both = np.union1d(out[i], np.array(back[i], np.int64))
        out[i] = both if len(both) <= 2 * degree else pruned(i, both)
    return out


def medoids(x: np.ndarray) -> np.ndarray:
    """The medoids of about sqrt(n) clusters of a block: a group of more near copies than a vector has neighbours lists nobody
    else, so a search has to begin close to it."""
    near = x @ kmeans(x, math.ceil(math.sqrt(len(x)))).T
    return np.unique(near.argmax(0))


def range_search(x: np.ndarray, graph: list[np.ndarray], q: np.ndarray, starts: list[int], least: float, beam: int = BEAM) -> np.ndarray:
    """Nodes whose cosine with q is at least ``least``, by greedy search that expands the range.

    First greedily: the best ``beam`` seen are kept, and expanded until none is left.  Then every node within the range,
    or a little beyond it, is expanded, until all of them have been.
    """
    seen = np.zeros(len(x), bool)
    starts = np.unique(starts)
    seen[starts] = True
    ids, sims = starts, x[starts] @ q
    done = np.zeros(len(x), bool)
    while True:
        order = np.argsort(-sims, kind="stable")
        within = sims >= least - SLACK
        front = np.zeros(len(ids), bool)
        front[order[:beam]] = True
        front = ids[(front | within) & ~done[ids]]
        if not len(front):
            return ids[sims >= least]
        # a greedy step expands the best few; within the range everything is expanded at once
        close = front[(x[front] @ q) >= least - SLACK]
        step = close if len(close) else front[np.argsort(-(x[front] @ q), kind="stable")[:4]]
        done[step] = True
        new = np.unique(np.concatenate([graph[i] for i in step.tolist()]))
        new = new[~seen[new]]
        seen[new] = True
        ids, sims = np.concatenate([ids, new]), np.concatenate([sims, x[new] @ q])


def _assign(centres, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = centres.value
        for pdf in batches:
            if not len(pdf):
                continue
            s = unit(stack(pdf.vector)) @ c.T
            m = min(overlap, c.shape[0])
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            yield pdf.assign(shards=list(np.sort(top, axis=1)))

    return run


def _build(reach: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """(of_shard, src, dst, near, inner): the graph of one block of one shard, for each shard that the source is in.

        An edge is of use where the neighbour is a member too (inner), and elsewhere only if it is near.
        """
        pdf = pdf.sort_values("vec_id")
        ids, shards, x = pdf.vec_id.to_numpy(), np.stack(pdf.shards.to_list()), unit(stack(pdf.vector))
        graph = build_graph(x)
        src, dst = np.repeat(np.arange(len(ids)), [len(g) for g in graph]), np.concatenate(graph)
        near = np.concatenate([x[g] @ x[i] >= reach for i, g in enumerate(graph)])
        out = []
        for of_shard in shards[src].T:
            inner = (shards[dst] == of_shard[:, None]).any(1)
            keep = inner | near
            out.append(pd.DataFrame({"of_shard": of_shard[keep], "src": ids[src[keep]], "dst": ids[dst[keep]], "near": near[keep], "inner": inner[keep]}))
        return pd.concat(out)

    return run


def reach_of(least: float) -> float:
    """The least cosine of an edge over which the expanding range can find a link: the angle between its ends is at most that
    from the query to one that is expanded (``least`` less the slack) and that to the link's other end (``least``)."""
    return math.cos(min(math.pi, math.acos(least) + math.acos(max(-1.0, least - SLACK))))


def packed(ids: np.ndarray, copies: np.ndarray) -> bytes:
    """Vectors and how many copies each has, in few bytes where ids are close."""
    o = np.argsort(ids)
    return zlib.compress(np.concatenate([np.diff(ids[o], prepend=0), copies[o]]).astype("<i8").tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    """(2, n): the ids and the copies."""
    x = np.frombuffer(zlib.decompress(raw), "<i8").reshape(2, -1)
    return np.stack([np.cumsum(x[0]), x[1]])


def _search(least: float, exact: bool = False):
    def run(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        """Queries of a block against its united graph; nodes that only a neighbour's list brought in are in it too.

        Rows (a, b, near): with b null, the packed vectors that a was linked with here, whichever of the two was the query;
        else a link that the components need.  exact: no graph, each query is compared with the whole index.  A group of near copies thus gives a row per member and not per pair.
        """
        index = nodes[nodes.role != 2].sort_values(["role", "vec_id"]).drop_duplicates("vec_id")
        ids = index.vec_id.to_numpy()
        out: list[tuple] = []
        queries = nodes[nodes.role.isin((0, 2))].drop_duplicates("vec_id")
        if len(ids) and len(queries):
            x = unit(stack(index.vector))
            copies, asked, asked_copies = index.copies.to_numpy(), queries.vec_id.to_numpy(), queries.copies.to_numpy()
            order = np.argsort(ids)
            find = lambda v: order[np.minimum(np.searchsorted(ids[order], v), len(ids) - 1)]
            src, dst = edges.src.to_numpy(np.int64), edges.dst.to_numpy(np.int64)
            i, j = find(src), find(dst)
            ok = (ids[i] == src) & (ids[j] == dst)
            i, j = np.r_[i[ok], j[ok]], np.r_[j[ok], i[ok]]
            o = np.argsort(i, kind="stable")
            graph = np.split(j[o], np.cumsum(np.bincount(i, minlength=len(ids)))[:-1])
            entries, root = [] if exact else medoids(x[: max(1, int((index.role < 2).sum()))]), {}  # members come first

            def top(v: int) -> int:
                while (p := root.setdefault(v, v)) != v:
                    root[v] = v = root.setdefault(p, p)
                return v

            bits = np.zeros((len(asked), -(-len(ids) // 8)), np.uint8)  # which of the index each query is linked with
            for k, (v, q) in enumerate(zip(asked.tolist(), unit(stack(queries.vector)), strict=True)):
                own = int(find(v))
                hits = np.flatnonzero(x @ q >= least) if exact else range_search(x, graph, q, [*entries, own] if ids[own] == v else entries, least)
                hits = hits[ids[hits] != v]
                row = np.zeros(len(ids), bool)
                row[hits] = True
                bits[k] = np.packbits(row)
                for w in ids[hits].tolist():
                    a, b = top(v), top(w)
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        out.append((v, w, None))
            place, back = {v: k for k, v in enumerate(asked.tolist())}, {}
            for c in range(len(ids)):  # the other direction: the queries that found each
                finders = np.flatnonzero(bits[:, c // 8] >> (7 - c % 8) & 1)
                if not len(finders):
                    continue
                if (k := place.get(int(ids[c]))) is None:
                    out.append((int(ids[c]), None, packed(asked[finders], asked_copies[finders])))
                else:
                    back[k] = finders
            for k, v in enumerate(asked.tolist()):
                hits, finders = np.flatnonzero(np.unpackbits(bits[k], count=len(ids))), back.get(k, np.empty(0, np.int64))
                if len(hits) or len(finders):
                    near, at = np.unique(np.r_[ids[hits], asked[finders]], return_index=True)
                    out.append((v, None, packed(near, np.r_[copies[hits], asked_copies[finders]][at])))
        return pd.DataFrame(out, columns=["a", "b", "near"]).astype({"a": "Int64", "b": "Int64"})

    return run


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, linked, n_near): the copies of all that a was linked with anywhere, each vector once, and how many vectors."""
    for pdf in batches:
        rows = []
        for a, lists in zip(pdf.a, pdf.lists, strict=True):
            x = np.concatenate([unpacked(raw) for raw in lists], axis=1)
            near, at = np.unique(x[0], return_index=True)
            rows.append((a, int(x[1][at].sum()), len(near)))
        yield pd.DataFrame(rows, columns=["a", "linked", "n_near"])


#: What _search() returns.
FOUND = "a long, b long, near binary"


def _every_block(reps: DataFrame, n: int, least: float) -> DataFrame:
    """_search() of each block of vectors in each other and in itself, without graphs."""
    last = max(1, math.ceil(n / BLOCK)) - 1
    own = reps.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.lit(last + 1)).cast("int"))
    index = own.select(F.explode(F.sequence(F.lit(0), "own")).alias("shard"), F.col("own").alias("block"), "vec_id", "vector", "copies", F.lit(1).alias("role"))
    queries = own.select(F.col("own").alias("shard"), F.explode(F.sequence(F.col("own"), F.lit(last))).alias("block"), "vec_id", "vector", "copies", F.lit(2).alias("role"))
    none = reps.sparkSession.createDataFrame([], "of_shard int, of_block int, src long, dst long")
    return index.unionByName(queries).groupBy("shard", "block").cogroup(none.groupBy("of_shard", "of_block")).applyInPandas(_search(least, exact=True), FOUND)


def _sharded(reps: DataFrame, n: int, least: float, overlap: int) -> DataFrame:
    """_search() in the graphs of overlapping shards."""
    spark = reps.sparkSession
    k = max(1, math.ceil(n / SHARD))
    sample = hash_sample(reps.select("vec_id", "vector"), min(FIT_SAMPLE, max(2_000, 20 * k)), "vec_id").toPandas()  # a documented bound
    centres = kmeans(unit(stack(sample.vector)), min(k, len(sample)))
    shared = spark.sparkContext.broadcast(centres)
    reps = materialize(reps.mapInPandas(_assign(shared, overlap), "vec_id long, vector array<double>, copies long, shards array<int>"), "reps")
    dealt = reps.withColumn("shard", F.explode("shards"))
    blocks = F.broadcast(dealt.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks")))  # a row per centre
    block = lambda c, shard: F.pmod(F.xxhash64(c, shard), "n_blocks").cast("int")  # noqa: E731  (each shard is split anew)
    dealt = dealt.join(blocks, "shard").withColumn("block", block("vec_id", "shard"))
    # the united lists of each block's members, and the neighbours that they bring in: those over edges that are cut here
    lists = dealt.groupBy("shard", "block").applyInPandas(_build(reach_of(least)), "of_shard int, src long, dst long, near boolean, inner boolean")
    lists = lists.join(blocks.withColumnRenamed("shard", "of_shard"), "of_shard").withColumn("of_block", block("src", "of_shard"))
    lists = materialize(lists.withColumn("cut", F.col("near") & (~F.col("inner") | (block("dst", "of_shard") != F.col("of_block")))).select("of_shard", "of_block", "src", "dst", "cut"), "lists")
    halo = lists.where("cut").select(F.col("of_shard").alias("shard"), F.col("of_block").alias("block"), F.col("dst").alias("vec_id")).distinct().join(reps, "vec_id")
    lists = lists.drop("cut")
    cols = ["shard", "block", "vec_id", "vector", "copies"]
    nodes = dealt.where("n_blocks = 1").select(*cols, F.lit(0).alias("role"))
    split = dealt.where("n_blocks > 1")
    nodes = nodes.unionByName(split.select(*cols, F.lit(1).alias("role")))
    nodes = nodes.unionByName(split.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(*cols, F.lit(2).alias("role")))
    nodes = nodes.unionByName(halo.select(*cols, F.lit(3).alias("role")))
    return nodes.groupBy("shard", "block").cogroup(lists.groupBy("of_shard", "of_block")).applyInPandas(_search(least), FOUND)


def near_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", overlap: int | None = OVERLAP) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(one row per vector: vec_id, n_links, component_id, kept; the classes; a, linked, n_near of those that have links).

    With an overlap of None all blocks are compared with each other, so no link is lost; that takes the square of the rows.

    Vectors link at a cosine of at least ``least`` in double precision.  Null, zero and empty vectors, and those with null
    or non-finite components, link with nothing and are their own component; vectors of different lengths don't link, and
    each length has an index of its own (few lengths are expected).  Equal vectors are one
    class, so their links are counted and not expanded.  A pair counts on both ends, and once, whichever shard or direction
    found it.  Rows with a null id are returned without links; rows
    that repeat an id are one vector, which isn't linked with itself, but copies under one id count; an empty table gives no rows.  Other columns are not read.
    """
    spark = vectors.sparkSession
    tune(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = F.expr("vec_id is not null and vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(vector, x -> x <> 0)")
    usable = rows.where(good)
    # classes of equal vectors; the hash deals, the vector itself decides
    classes = usable.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("size", F.size("vector")), "classes")
    sizes = sizes_of(classes)
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")), None, None
    found = None
    for size, n in sizes.items():
        reps = classes.where(F.col("size") == size).select(F.col("rep").alias("vec_id"), "vector", "copies")
        some = _every_block(reps, n, least) if overlap is None else _sharded(reps, n, least, overlap)
        found = some if found is None else found.unionByName(some)
    found = materialize(found, "found", free=True)

    n_links = found.where("b is null").groupBy("a").agg(F.collect_list("near").alias("lists")).mapInPandas(_count, "a long, linked long, n_near long")
    n_links = materialize(n_links, "links")
    comps = connected_components(found.where("b is not null"), "a", "b")
    per_class = classes.join(n_links, classes.rep == n_links.a, "left").join(comps, classes.rep == comps.node, "left")
    per_class = per_class.select("vector", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    named = rows.withColumn("v", F.when(good, F.col("vector"))).drop("vector").join(per_class.withColumnRenamed("vector", "v"), "v", "left")
    out = named.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return materialize(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "vectors"), classes, n_links


def sizes_of(classes: DataFrame) -> dict[int, int]:
    """How many classes there are of each length of vectors, a row per length."""
    return {r["size"]: r["count"] for r in classes.groupBy("size").count().orderBy("size").collect()}


def audit_recall(classes: DataFrame, linked: DataFrame, least: float = 0.95, queries: int = AUDIT) -> float:
    """The mean share of a vector's near vectors that ``linked`` has (a, n_near), over those of the queries that have some.

    Vectors are distinct: copies count neither for a query nor as what it is near to.  Queries are chosen by a hash of their
    ids, whatever the result; all vectors are scanned in blocks.  Of too few linked queries, eight times as many are taken.
    """
    spark = classes.sparkSession
    q = hash_sample(classes.select("rep", "vector"), queries, "rep").toPandas().drop_duplicates("rep")  # no more than ``queries``
    if not len(q):
        return 1.0
    held = spark.sparkContext.broadcast((q.rep.to_numpy(), unit(stack(q.vector))))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x = held.value
        n = np.zeros(len(ids), np.int64)
        for pdf in batches:
            if len(pdf):
                # a vector is not near itself, whatever the rounding
                n += ((unit(stack(pdf.vector)) @ x.T >= least) & (pdf.rep.to_numpy()[:, None] != ids)).sum(0)
        yield pd.DataFrame({"a": ids, "n": n})

    true = classes.select("rep", "vector").mapInPandas(scan, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).toPandas()
    found = linked.join(F.broadcast(spark.createDataFrame(q[["rep"]], "rep long")), F.col("a") == F.col("rep")).select("a", "n_near").toPandas()
    got = true[true.n > 0].merge(found, on="a", how="left").fillna({"n_near": 0})
    if len(got) < AUDIT_LINKED and queries == AUDIT:
        return audit_recall(classes, linked, least, 8 * queries)
    return 1.0 if not len(got) else float((np.minimum(got.n_near, got.n) / got.n).mean())


def embedding_near_dedup(vectors: DataFrame, least: float = 0.95, target: float = 0.9, **names) -> DataFrame:
    """near_vectors(), built again with more overlap, and at last without graphs, while the audited recall is below the target."""
    for overlap in (OVERLAP, 2 * OVERLAP, 4 * OVERLAP, None):
        out, classes, linked = near_vectors(vectors, least, overlap=overlap, **names)
        recall = 1.0 if classes is None else min(audit_recall(classes.where(F.col("size") == size), linked, least) for size in sizes_of(classes))
        if recall >= target:
            break
    return out.withColumn("audited_recall", F.lit(float(recall)))
