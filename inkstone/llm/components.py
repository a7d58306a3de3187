"""Connected components of a graph held in DataFrames: alternating large-star and small-star steps.

Each step pre-aggregates the smallest neighbour of a node before the shuffle and joins it back, so a node with very
many links is one row after aggregation, and its rows can be split by Spark's skew join.  No links reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    all_ = _both(edges)
    least = all_.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return all_.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that it reaches.

    Self-loops, repeated edges, edges with a null end and an empty table are allowed; the last gives no rows.
    """
    e = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u <> v").distinct()
    now, mark = materialize(e, "edges"), None
    most = 2 * now.count()  # a round gives no more than an edge for each edge and node
    for _ in range(rounds):
        new = materialize(_small_star(_large_star(now)), "edges", most=most)
        got = new.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(v, u) % 1000003"))).first()
        drop(now)
        now = new
        if tuple(got) == mark or got[0] == 0:
            break
        mark = tuple(got)
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
