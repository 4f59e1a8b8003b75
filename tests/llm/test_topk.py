import math
from fractions import Fraction

import numpy as np
import pytest

from lectern.llm.topk_search import exact_top_k


def brute(rows, k=5, kind=np.float32):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            fine[i] = [math.floor(Fraction(float(kind(x))) * 256) for x in v]
    out = []
    for q, x in fine.items():
        if q % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in fine.items() if i != q and len(y) == len(x)))[:k]
            out += [(q, r + 1, i, min(2**63 - 1, max(-(2**63), -s))) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 3])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=8) / 3)]) for i in range(600)]
    rows += [(i + 600, rows[i % 7][1]) for i in range(100)]  # ties
    rows += [(900, None), (950, []), (1000, [1.0, None] + [0.0] * 6), (1050, [float("nan")] + [0.0] * 7), (1100, [float("inf")] + [0.0] * 7), (None, rows[0][1])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, vector string, rank int").repartition(5)
    assert sorted(map(tuple, exact_top_k(frame, query_block=block).collect())) == brute(rows)


def test_few_rows_widths_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.5, 0.5]), (1, [0.25, 1.0]), (2, [0.1, 0.2, 0.3]), (2, [0.1, 0.2, 0.3])]
    assert sorted(map(tuple, exact_top_k(spark.createDataFrame(rows, kind)).collect())) == brute(rows)
    assert exact_top_k(spark.createDataFrame([], kind)).count() == 0
    assert exact_top_k(spark.createDataFrame([(0, [1.0])], kind)).count() == 0


@pytest.mark.parametrize("size", [3e5, 1e6, 3e7, 1e17, 1e30, 1e300])
def test_components_of_any_size_are_exact(spark, size):
    """Also where products pass 2^53 and where scores pass the range of a long."""
    rng = np.random.default_rng(int(np.log10(size)))
    rows = [(i, [float(x) for x in rng.normal(size=64) * size]) for i in range(120)]
    rows += [(200 + i, rows[i % 5][1]) for i in range(20)] + [(300, [size] * 64), (301, [size] * 63 + [size * (1 + 2**-40)])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, exact_top_k(frame).collect())) == brute(rows, kind=float)


def test_rows_below_the_bound_are_passed_over(spark):
    """Most rows point away from all queries, so their leading list and the norms of the rest rule them out."""
    import numpy as np

    from lectern.llm import topk_search as T

    rng = np.random.default_rng(5)
    q = np.floor(256 * rng.normal(size=(3, 16)) * np.array([1.0] * 4 + [0.01] * 12))
    x = np.concatenate([q[rng.integers(0, 3, 20)], -q[rng.integers(0, 3, 400)]])
    lead, rest = slice(0, 4), np.arange(4, 16)
    bound = (q * q).sum(axis=1) * 0.9
    first, left = T._open_pairs(q, x, lead, rest, T._norms(q[:, rest]), bound)
    assert (first == q[:, :4] @ x[:, :4].T).all()
    assert not ((q @ x.T >= bound[:, None]) & ~left).any()
    assert left.any(axis=0).sum() < 40
    rows = [(i, [float(v) for v in np.float32(w)]) for i, w in enumerate(np.concatenate([x / 256, rng.normal(size=(200, 16)) * 0.1]))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    assert sorted(map(tuple, exact_top_k(frame).collect())) == brute(rows)
