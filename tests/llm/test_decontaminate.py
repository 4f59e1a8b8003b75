import random
from collections import Counter

import numpy as np

from lectern.llm.decontaminate import RADIUS, HammingIndex, contaminated, drop_contaminated
from lectern.llm.queries import op7_decontamination

from .conftest import prose


def words(text):
    import re

    return re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower())


def brute(docs, items):
    out = {}
    for i, t in docs:
        w = words(t)
        for k, u in items:
            v = words(u)
            n = min(5, len(v))
            if not v or len(w) < n:
                continue
            own = Counter(tuple(v[a : a + n]) for a in range(len(v) - n + 1))
            for s in range(max(0, len(w) - len(v)) + 1):
                x = w[s : s + len(v)]
                got = Counter(tuple(x[a : a + n]) for a in range(len(x) - n + 1))
                same = sum((own & got).values())
                value = same / (sum(own.values()) + sum(got.values()) - same)
                if value >= 0.8 and value > out.get((i, k), (0,))[0]:
                    out[i, k] = (value, s)
    return out


def test_index_finds_every_print_within_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, RADIUS + 1), replace=False)) for _ in range(300)], np.uint64)
    found = set(zip(*(x.tolist() for x in HammingIndex(prints)(prints ^ flips)), strict=True))
    assert all((i, i) in found for i in range(300))


def test_against_brute_force(spark, odd, odd_rows, nothing):
    items = [(1, prose(71, 30)), (2, prose(72, 18)), (3, "only three words"), (4, None), (5, ""), (6, prose(76, 60)), (1, prose(71, 30))]
    rng, docs = random.Random(9), []
    for i in range(40):
        text = prose(500 + i, 80).split()
        item = items[(0, 1, 2, 5)[i % 4]][1].split()
        for _ in range(i % 5):
            item[rng.randrange(len(item))] = "changed"
        docs.append((i, " ".join(text[:20] + item + text[20:])))
    docs += [(100, None), (101, ""), (102, items[0][1].upper().replace(" ", " *** ")), (103, " ".join([items[1][1]] * 3))]
    docs += [(104 + k, " ".join(items[5][1].split()[k : 60 - k])) for k in range(8)] + [(112, "only three"), (113, " ".join(items[1][1].split()[:3]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, dict((k, u) for k, u in items if u).items())
    for size in (32_000_000, 200):  # one pass, and passes of a few items
        got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in contaminated(frame, bench, size).collect()}
        assert set(got) == set(want)
        assert all(abs(got[k][0] - want[k][0]) < 1e-9 for k in want)
    kept = {r.doc_id for r in drop_contaminated(frame, bench).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}
    assert contaminated(odd, bench).count() == 0 and contaminated(nothing, bench).count() == 0
    assert drop_contaminated(odd, bench.limit(0)).count() == len(odd_rows)


def test_query_on_a_table(spark):
    folder = "/root/testdata/sf0.001"
    read = lambda n, k: [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/{n}.parquet").select(k, "text").collect()]
    items = read("benchmark", "item_id")
    grams = {}
    for k, u in items:
        v = words(u)
        for a in range(len(v) - 4):
            grams.setdefault(tuple(v[a : a + 5]), set()).add(k)
    want = {}
    for i, t in read("documents", "doc_id"):
        w = words(t)
        near = {k for a in range(len(w) - 4) for k in grams.get(tuple(w[a : a + 5]), ())}
        want.update(brute([(i, t)], [(k, u) for k, u in items if k in near]))
    assert {(r.doc_id, r.item_id) for r in op7_decontamination(spark, folder).collect()} == set(want)
