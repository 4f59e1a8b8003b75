"""Exact top-k inner-product search by a three-phase uniform threshold.

A score is the sum of one list per block of dimensions.  Phase one ranks every
partition's rows by the queries' leading list, resolves the best of them and
gathers their scores: the k-th best is a safe cutoff of each query.  Phase two
broadcasts the cutoff; a pair whose leading list and the norms of what is left
(Cauchy-Schwarz) stay below it is passed over before anything else is multiplied,
and so is a row that has no other pair.  Of the rows left it collects every pair
with one list at or above the cutoff's even share (no other pair can reach it),
and phase three resolves those; where few pairs are left they are resolved one by
one.  All arithmetic is on integers that are held exactly.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import shared_folder

#: Queries that one pass holds: at most this many vectors, and bytes, are broadcast at once.
QUERY_BLOCK = 2048
QUERY_BYTES = 32_000_000
LISTS = 4
ROW_BLOCK = 2048
#: Share of open pairs below which they are resolved one by one.
FEW = 1 / 64
SCALE = 256
LEAST, MOST = -(2**63), 2**63 - 1


def _lists(width: int) -> list[slice]:
    edge = np.linspace(0, width, min(LISTS, width) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edge, edge[1:], strict=False)]


def _kind(width: int, largest: float) -> str:
    """The cheapest numbers that hold every partial inner product of such components exactly."""
    bound = width * (SCALE * int(largest) + SCALE) ** 2
    return "float64" if bound < 2**53 else "int64" if bound < 2**63 else "object"


def _quantised(x: np.ndarray, kind: str) -> np.ndarray:
    """floor(256 x); past 2^53 a double is whole, and so is its 256-fold."""
    if kind == "object":
        flat = [SCALE * int(v) if abs(v) >= 2**53 else int(np.floor(SCALE * v)) for v in x.ravel().tolist()]
        out = np.empty(len(flat), object)
        out[:] = flat
        return out.reshape(x.shape)
    return np.floor(SCALE * x).astype(kind)


def _matrix(batch: pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    cells = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return ids, _quantised(cells.reshape(len(ids), -1), kind) if len(ids) else np.empty((0, 0))


def _best(values: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest values of each row, in no order."""
    if values.dtype == object:
        return np.argsort(-values, axis=1, kind="stable")[:, :k]
    return np.argpartition(-values, min(k, values.shape[1]) - 1, axis=1)[:, :k]


def _exact(queries: Broadcast) -> tuple[np.ndarray, np.ndarray, str]:
    ids, vectors, kind = queries.value[:3]
    return ids, _quantised(vectors, kind), kind


def _leading_list(vectors: np.ndarray) -> slice:
    return max(_lists(vectors.shape[1]), key=lambda s: float(np.abs(vectors[:, s]).max()))


def _below(scores: np.ndarray) -> np.ndarray:
    """A double just under each score: a cutoff may be too low, never too high."""
    if scores.dtype == object:
        scores = np.array([[float(min(v, 10**300)) if v > -(10**300) else -np.inf for v in line] for line in scores])
    return np.nextafter(scores.astype(np.float64), -np.inf)


def _safe_scores(queries: Broadcast, k: int):
    """Phase one, in a partition: the k best resolved scores of each query among the best rows of its leading list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, kind = _exact(queries)
        lead = _leading_list(queries.value[1])
        held = np.full((len(q_ids), 0), -np.inf)
        for batch in batches:
            ids, rows = _matrix(batch, kind)
            for at in range(0, len(ids), ROW_BLOCK):
                part, x = ids[at : at + ROW_BLOCK], rows[at : at + ROW_BLOCK]
                seen = _best(q[:, lead] @ x[:, lead].T, k + 1)  # one more: a query may meet itself
                score = np.stack([(q * x[seen[:, j]]).sum(axis=1) for j in range(seen.shape[1])], axis=1)
                low = _below(score)
                low[part[seen] == q_ids[:, None]] = -np.inf
                held = np.sort(np.concatenate([held, low], axis=1), axis=1)[:, -k:]
        real = np.isfinite(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(q_ids[:, None], real.shape)[real], pa.int64()), pa.array(held[real], pa.float64())], ["query_id", "score"])

    return run


def _norms(vectors: np.ndarray) -> np.ndarray:
    """Euclidean norms as doubles, a little above."""
    x = vectors.astype(np.float64)
    top = np.maximum(np.abs(x).max(axis=1), 1.0) if x.shape[1] else np.ones(len(x))
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9)


def _open_pairs(q: np.ndarray, x: np.ndarray, lead: slice, rest: np.ndarray, norms: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the leading list, pairs that can still reach the cutoff by it and the norms of the other dimensions)."""
    first = q[:, lead] @ x[:, lead].T
    if q.dtype == object:  # numbers past all doubles: every pair stays open
        return first, np.ones(first.shape, bool)
    with np.errstate(over="ignore", invalid="ignore"):
        most = first.astype(np.float64) + norms[:, None] * _norms(x[:, rest])[None, :]
        most = most + 1e-9 * np.abs(most)
    return first, ~(most < bound[:, None])


def _sufficient(queries: Broadcast, k: int):
    """Phases two and three, in a partition: the pairs that the bounds leave open, resolved, the k best of each query kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, kind = _exact(queries)
        bound = queries.value[3]
        spans, lead = _lists(q.shape[1]), _leading_list(queries.value[1])
        rest = np.array([d for d in range(q.shape[1]) if not lead.start <= d < lead.stop], np.int64)
        norms = _norms(q[:, rest]) if kind != "object" else np.zeros(len(q))
        share = bound / len(spans)
        share = np.nextafter(share, -np.inf)[:, None]
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, q.dtype))
        for batch in batches:
            ids, rows = _matrix(batch, kind)
            for at in range(0, len(ids), ROW_BLOCK):
                part, x = ids[at : at + ROW_BLOCK], rows[at : at + ROW_BLOCK]
                first, left = _open_pairs(q, x, lead, rest, norms, bound)
                left &= q_ids[:, None] != part[None, :]
                some = np.flatnonzero(left.any(axis=0))
                if not len(some):
                    continue
                if left.sum() <= FEW * left.size:
                    qi, ri = np.nonzero(left)
                    score = np.concatenate([first[a, b] + (q[np.ix_(a, rest)] * x[np.ix_(b, rest)]).sum(axis=1) for a, b in zip(np.array_split(qi, 1 + len(qi) // 65_536), np.array_split(ri, 1 + len(ri) // 65_536), strict=True)])
                else:
                    part, x, left, first = part[some], x[some], left[:, some], first[:, some]
                    partial = [first if s == lead else q[:, s] @ x[:, s].T for s in spans]
                    left &= np.logical_or.reduce([(p >= share).astype(bool) for p in partial])
                    qi, ri = np.nonzero(left)
                    score = sum(p[qi, ri] for p in partial)
                fit = (score >= bound[qi]).astype(bool)
                held = tuple(np.concatenate(z) for z in zip(held, (q_ids[qi[fit]], part[ri[fit]], score[fit]), strict=True))
                order = np.lexsort((held[1], -held[2], held[0])) if kind != "object" else np.array(sorted(range(len(held[0])), key=lambda i: (held[0][i], -held[2][i], held[1][i])), np.int64)
                held = tuple(z[order] for z in held)
                keep = np.arange(len(order)) - np.searchsorted(held[0], held[0]) < k
                held = tuple(z[keep] for z in held)
        # Scores past the range of a long are ordered by their digits and reported as its ends.
        whole = [int(v) for v in held[2]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(held[0], pa.int64()), pa.array(held[1], pa.int64()), pa.array([min(MOST, max(LEAST, v)) for v in whole], pa.int64()), pa.array([_digits(v) for v in whole], pa.string())],
            ["query_id", "vec_id", "score", "digits"],
        )

    return run


def _digits(value: int) -> str | None:
    """A key for scores past the range of a long, which sorts as they do; null within it."""
    if LEAST < value < MOST:
        return None
    size = 700  # decimal digits of a product of two doubles' 256-folds, at most
    return f"1{value:0{size}d}" if value > 0 else f"0{10**size + value:0{size}d}"


def exact_top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every query.

    Queries are the rows whose vec_id is divisible by ``query_every``; each meets
    every other row of its width.  Components become floor(256 x); the score is
    their integer inner product, exact for components of any size, ties go to the
    smaller vec_id, a query with fewer rows gets them all.  A score that no long
    holds is reported as the greatest or least long, in its exact place.  Rows with a null
    id or vector, an empty vector, or a null or non-finite component take no part;
    repeated rows of one id count as one (the smallest vector); further columns are
    ignored; no rows give no rows.

    Queries go in blocks of bounded bytes, one broadcast at a time; a block's k rows
    a query are written to the shared folder before the next one starts, so neither
    what is broadcast nor the plan grows.
    """
    spark = vectors.sparkSession
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    whole = vectors.select("vec_id", x).filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine).select("vec_id", x.alias("vector"), F.size(x).alias("width"))
    if whole.groupBy("vec_id").count().filter("count > 1").limit(1).count():
        whole = whole.groupBy("vec_id").agg(F.min(F.struct("vector", "width")).alias("x")).select("vec_id", "x.vector", "x.width")
    largest = F.array_max(F.transform("vector", lambda c: F.abs(c.cast("double"))))
    sizes = whole.groupBy("width").agg(F.count_if(F.pmod("vec_id", F.lit(query_every)) == 0).alias("n"), F.max(largest).alias("largest")).filter("n > 0").collect()
    asked = whole.filter(F.pmod("vec_id", F.lit(query_every)) == 0)
    folder, written = f"{shared_folder(spark).rstrip('/')}/topk-{uuid.uuid4().hex}", []
    for width, n, top in sorted(map(tuple, sizes)):
        kind = _kind(width, top)
        blocks = -(-n // max(1, min(query_block, QUERY_BYTES // (8 * width))))
        alike = asked.filter(F.col("width") == width).select("vec_id", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
        rows = whole.filter(F.col("width") == width).select("vec_id", "vector")
        for block in range(blocks):
            held = alike.filter(F.col("block") == block).select("vec_id", "vector").toArrow()
            if held.num_rows == 0:
                continue
            q_ids = held.column("vec_id").to_numpy()
            q = np.array(held.column("vector").to_pylist(), np.float64)
            shared = spark.sparkContext.broadcast((q_ids, q, kind))
            first = rows.mapInArrow(_safe_scores(shared, k), "query_id long, score double")
            order = Window.partitionBy("query_id").orderBy(F.desc("score"))
            cutoff = first.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select("query_id", "score").toArrow()
            bound = np.full(len(q_ids), -np.inf)
            at = {int(i): p for p, i in enumerate(q_ids)}
            for i, s in zip(cutoff.column(0).to_pylist(), cutoff.column(1).to_pylist(), strict=True):
                bound[at[i]] = s
            shared.destroy()
            shared = spark.sparkContext.broadcast((q_ids, q, kind, bound))
            found = rows.mapInArrow(_sufficient(shared, k), "query_id long, vec_id long, score long, digits string")
            order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("digits"), F.asc("vec_id"))
            path = f"{folder}/{len(written)}"
            found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.parquet(path)
            written.append(path)
            shared.destroy()
    if not written:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(*written)
