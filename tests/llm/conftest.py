import random

import pytest

EXTRA = ("cluster", "bands", "shard", "window", "held_out", "label", "r", "component_id", "ids", "kept", "node", "words", "block", "low")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(("ka", "lo", "mi", "ren", "su", "ta")) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows, a null id."""
    base = prose(1, 60)
    rows = [
        (1, base), (2, None), (3, ""), (4, " \n\t "), (5, prose(5, 60_000)), (6, base), (7, base.upper()), (8, "short"), (9, "short"),
        (10, base + " one more"), (11, "1234 5678 !!"), (12, prose(12, 13)), (13, prose(12, 13)), (14, "x" * 40_000), (15, "été ünïcode 你好 \U0001f600 text"),
        (None, base), (1, base), (20, prose(20, 5)), (21, prose(20, 5)),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with further columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, None if i and i % 4 == 0 else "xx" if i and i % 2 else "yy", "s", len(t or ""), *["e"] * len(EXTRA)) for i, t in odd_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, None if i == 3 else int(i % 3 == 0)) for i in range(1, 16)], "doc_id long, quality int, toxic int")
