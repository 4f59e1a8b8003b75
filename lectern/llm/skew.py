"""Joins that no hot key piles up in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that may count as hot at once: the broadcast side of a join has so many rows at most.
HOT_KEYS = 1000
#: Rows up to which a whole side of a few numbers a row is broadcast, where their count is known.
BROADCAST_ROWS = 200_000


def hot_limit(rows: int) -> int:
    """Rows from which a key is hot: at most HOT_KEYS keys of ``rows`` rows can have as many."""
    return max(500, -(-rows // HOT_KEYS))


def join_hot(left: DataFrame, right: DataFrame, on: list[str], hot: Column, rows: int, how: str = "inner") -> DataFrame:
    """left joined to right, which has one row a key and at most ``rows`` of them (a few numbers each).

    Up to BROADCAST_ROWS right is broadcast whole; beyond, only its rows that are
    ``hot``, and the others are shuffled.  hot: a condition on right that holds for
    HOT_KEYS rows at most.
    """
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    columns = [*left.columns, *(c for c in right.columns if c not in on)]
    few = right.filter(hot).withColumn("_hot", F.lit(True))
    marked = left.join(F.broadcast(few), on, "left")
    cold = marked.filter("_hot IS NULL").select(*left.columns).join(right.filter(~hot), on, how)
    return marked.filter("_hot").select(*columns).unionByName(cold.select(*columns))
