import hashlib
import random

import pytest

from lectern.llm import substring_dedup
from lectern.llm.substring_dedup import remove_repeats

from .conftest import prose


def brute(rows):
    first, out = {}, []
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(i, first.get(key, i))
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_odd_rows(odd, odd_rows, nothing):
    assert sorted(map(tuple, remove_repeats(odd).collect())) == brute([(i, t) for i, t in odd_rows if i is not None])
    assert remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("bits", [28, 7])
def test_shared_passages(spark, monkeypatch, bits):
    """A filter too small for its anchors lets more through and changes nothing."""
    monkeypatch.setattr(substring_dedup, "FILTER_BITS", bits)
    rng, shared = random.Random(6), [prose(900 + k, 40) for k in range(4)]
    rows = []
    for i in range(80):
        parts = [prose(1000 + i, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared).split()
            a = rng.randrange(20)
            parts += [" ".join(p[a : a + rng.randint(10, 30)]), prose(rng.randint(0, 10**6), rng.randint(0, 8))]
        rows.append((i, "\n ".join(parts)))
    rows += [(200 + i, rows[3][1]) for i in range(10)] + [(300, shared[0] + " " + shared[0])]
    assert sorted(map(tuple, remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_kept_words(spark):
    text = prose(1, 30)
    frame = spark.createDataFrame([(1, text), (2, "before " + text + " after")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept).decode() for r in remove_repeats(frame, with_text=True).collect()}
    assert got == {1: text, 2: "before after"}
