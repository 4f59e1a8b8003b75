"""Vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def is_finite(a: Column, size: int | None = None) -> Column:
    fine = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return a.isNotNull() & fine & ((F.size(a) == size) if size else F.lit(True))


def synthetic(seed: Column, size: int) -> Column:
    """((seed + 17 i) mod 101) - 50 for each component, to unit length."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (F.pmod(seed + 17 * i, F.lit(101)) - 50).cast("double"))
    length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: x / length)
