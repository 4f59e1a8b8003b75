import itertools
import random
from collections import Counter, defaultdict

import pytest

from lectern.llm import near_dedup
from lectern.llm.components import connected_components
from lectern.llm.near_dedup import near_duplicates


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) >= 5:
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    return {tuple(words)} if words else set()


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index, common = defaultdict(set), Counter()
    for i, s in sets.items():
        for g in s:
            index[g].add(i)
    for ids in index.values():
        common.update(itertools.combinations(sorted(ids), 2))
    for (a, b), k in common.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(frame, rows, percent=85):
    want = brute([(i, t) for i, t in rows if i is not None], percent)
    got = near_duplicates(frame, percent).collect()
    assert len(got) == sum(i is not None for i, _ in rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_odd_rows(odd, odd_rows, nothing):
    check(odd, odd_rows)
    assert near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("block", [512, 8])
def test_large_groups_of_near_copies_in_blocks(spark, monkeypatch, block):
    """Every link counts, whether a cluster is one block or is compared block by block."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 400)}" for _ in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"v{rng.randint(0, 9999)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(base)) for i in range(40)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


@pytest.mark.parametrize("block", [512, 6])
@pytest.mark.parametrize("percent", [85, 80])
def test_texts_that_meet_by_chance(spark, monkeypatch, block, percent):
    """Many texts alike by half share buckets; only those past the threshold are linked, in chains and apart from the largest group."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 900)}" for _ in range(120)]
    rows, chain = [], list(base)
    for i in range(60):
        rows.append((i, " ".join(base[:90] + [f"x{i}y{k}" for k in range(30)])))  # alike by 0.5
    for i in range(40):  # neighbours are alike, ends are not
        for _ in range(2):
            chain[rng.randrange(120)] = f"c{i}v{rng.randint(0, 9999)}"
        rows.append((100 + i, " ".join(chain)))
    for i in range(60):
        words = list(base)
        at = rng.randrange(100)
        words[at : at + rng.randint(1, 16)] = [f"z{i}"]
        rows.append((200 + i, " ".join(words)))
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, percent)


def test_banding():
    assert near_dedup.banding(85) == (30, 6) and near_dedup.banding(80) == (36, 5)


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, k) for k in range(1001, 1400)] + [(5, 5), (7, 6)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 1000 for i in range(1000, 1400))
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
