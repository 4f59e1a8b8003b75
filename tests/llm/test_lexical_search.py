import math
import random
import re
from collections import Counter

import pytest

from lectern.llm import lexical_search as module
from lectern.llm.lexical_search import Shard, lexical_search
from lectern.llm.queries import op13_lexical_search

from .conftest import prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    bags = [(i, terms(t)) for i, t in docs if i is not None]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    texts = {}
    for i, t in items:
        if i is not None and t is not None:
            texts[i] = min(texts.get(i, t), t)
    out = []
    for item, text in texts.items():
        scored = []
        for i, bag in bags:
            tf, m = Counter(bag), 25 + (75 * len(bag) * n_docs) // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms(text) if tf[t])
            if score > 0:
                scored.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize(("shard", "k", "item_bytes"), [(8_000_000, 10, 4_000_000), (500, 3, 4_000_000), (1, 1, 60)])
def test_against_brute_force(spark, monkeypatch, shard, k, item_bytes):
    monkeypatch.setattr(module, "SHARD_BYTES", shard)
    rng = random.Random(shard)
    words = ["Ä", "é1", "a-b", "x_y", "0", "Zz", "the", "THE", "你好", "a\x00b", *prose(3, 60).split()]
    weights = [1 / (r + 1) for r in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice((0, 3, 30))))) for i in range(250)]
    docs += [(300 + i, docs[i][1]) for i in range(40)] + [(7, docs[7][1]), (None, docs[1][1]), (400, None), (401, "-- !!")]
    items = [(i, " ".join(rng.choices(words, k=rng.choice((1, 4, 12))))) for i in range(12)] + [(20, None), (21, ""), (22, "nowhere"), (None, "the"), (3, "the the the")]
    assert sorted(map(tuple, lexical_search(*frames(spark, docs, items), k=k, item_bytes=item_bytes).collect())) == brute(docs, items, k)


def test_odd_rows(spark, odd, odd_rows, nothing):
    items = [(1, odd_rows[0][1]), (2, "x" * 40_000), (3, "ünïcode 你好 1234"), (4, "été")]
    asked = spark.createDataFrame([(*r, "e", 1) for r in items], "item_id long, text string, score string, rank int")
    assert sorted(map(tuple, lexical_search(odd, asked).collect())) == brute(odd_rows, items)
    assert lexical_search(nothing, asked).count() == 0
    assert lexical_search(odd, asked.limit(0)).count() == 0


def test_lists_are_split_by_their_bounds(monkeypatch):
    """Non-essential lists are probed for the documents of essential ones alone, and a shard that cannot qualify not at all."""
    import numpy as np

    row, term = np.array([0, 1, 2, 3, 3]), np.array([0, 0, 0, 0, 1])
    shard = Shard(np.arange(4), np.full(4, 5), row, term, np.ones(5, np.int64), np.array([10, 1000]), 4, 20)
    low, high = shard.bound.tolist()
    asked = np.array([0, 1]), np.array([1, 1])
    assert [x.tolist() for x in shard.search(*asked, 1)] == [[0, 1, 2, 3], [low, low, low, low + high]]
    assert [x.tolist() for x in shard.search(*asked, low)] == [[0, 1, 2, 3], [low, low, low, low + high]]
    assert [x.tolist() for x in shard.search(*asked, low + 1)] == [[3], [low + high]]
    assert [x.tolist() for x in shard.search(*asked, low + high + 1)] == [[], []]
    assert not shard.score.any()


def test_query_on_a_table(spark):
    folder = "/root/testdata/sf0.001"
    tables = [[tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(key, "text").collect()] for name, key in (("documents", "doc_id"), ("benchmark", "item_id"))]
    assert sorted(map(tuple, op13_lexical_search(spark, folder).collect())) == brute(*tables)
