"""Merges of a target with incoming rows, as DataFrame to DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(frame: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upsert(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows replace those of the same key."""
    return target.join(incoming.select(*keys).distinct(), list(keys), "left_anti").unionByName(incoming)


def replace_children(target: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """All children of the parents that come in are replaced by the incoming ones."""
    return upsert(target, incoming, [parent])


def soft_delete(target: DataFrame, incoming: DataFrame, keys: Sequence[str], flag: str = "is_active") -> DataFrame:
    """The target with a flag: whether the key still comes in."""
    seen = incoming.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return target.join(seen, list(keys), "left").withColumn(flag, F.col("_seen").isNotNull()).drop("_seen")


def merge_columns(target: DataFrame, incoming: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Full outer merge; listed columns take the incoming value where there is one, others stay."""
    new = incoming.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    both = target.join(new, list(keys), "full_outer")
    return both.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns])


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys and status: created, updated, unchanged or deleted, by null-safe comparison."""
    a = old.select(*keys, F.struct(*columns).alias("_a"))
    b = new.select(*keys, F.struct(*columns).alias("_b"))
    state = F.when(F.col("_a").isNull(), "created").when(F.col("_b").isNull(), "deleted").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("updated")
    return a.join(b, list(keys), "full_outer").select(*keys, state.alias("status"))


def increment(state: DataFrame, events: DataFrame, key: str, counter: str) -> DataFrame:
    """Counters raised by the events of each key, from 0 for new keys."""
    n = events.groupBy(key).agg(F.count("*").alias("_n"))
    return state.join(n, key, "full_outer").select(key, (F.coalesce(counter, F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias(counter))
