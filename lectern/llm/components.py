"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut
from .skew import hot_limit, join_hot


def _with_least(edges: DataFrame, least: DataFrame, size: int) -> DataFrame:
    """edges with their u's least neighbour m."""
    return join_hot(edges, least, ["u"], F.col("n") > hot_limit(2 * size), 2 * size)


def _large_star(edges: DataFrame, size: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return _with_least(both.filter("v > u"), least, size).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, size: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(down, least, size).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reached.

    edges: two long columns u and v.  Self loops, repeats and null ends are
    ignored; no edges give no rows.  Each round moves every node to a smaller
    neighbour, pre-aggregates the minimum of a node before its shuffle, broadcasts
    the minima of few edges, or those of the few nodes of very many edges, and ends
    on a checkpoint, so lost executors never replay earlier rounds.
    """
    now = cut(edges.select("u", "v").filter("u <> v").distinct())
    size, seen = now.count(), None
    for _ in range(max_rounds):
        if not size:
            break
        now = cut(_small_star(_large_star(now, size), size))
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if state == seen:
            break
        seen, size = state, state.n
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
