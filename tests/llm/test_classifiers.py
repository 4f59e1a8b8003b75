import random
import zlib

import numpy as np

from lectern.llm.quality import AttentionModel, quality
from lectern.llm.queries import op6_toxicity, op10_quality
from lectern.llm.toxicity import LATER, toxicity, windows_of

from .conftest import prose


def test_gradients_of_the_attention_model():
    rng = np.random.default_rng(1)
    model = AttentionModel()
    counts, y = np.array([1, 3, 2]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(size=(6, model.p["w"].shape[0]))

    def loss():
        s, _ = model.forward(x, counts)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name, gradient in model.gradients(x, counts, y).items():
        where = tuple(rng.integers(0, n) for n in model.p[name].shape)
        kept = model.p[name][where]
        model.p[name][where] = kept + 1e-6
        high = loss()
        model.p[name][where] = kept - 1e-6
        low = loss()
        model.p[name][where] = kept
        assert abs((high - low) / 2e-6 - gradient[where]) < 1e-6


def test_odd_rows(odd, odd_rows, nothing, labels):
    for f, modulus, fold in ((quality, 5, 0), (toxicity, 3, 1)):
        rows = f(odd, labels).collect()
        assert len(rows) == len(odd_rows)
        assert all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == fold) for r in rows)
        assert f(nothing, labels).count() == 0
        assert f(odd, labels.limit(0)).count() == len(odd_rows)


def test_toxic_words_are_learned_and_held_out(spark):
    rng, bad = random.Random(3), ("grumbol", "snarfety", "blotchit")
    docs, marks = [], []
    for i in range(600):
        toxic = int(i % 4 == 0)
        words = prose(i, 60).split()
        for _ in range(4 * toxic):
            words[rng.randrange(60)] = rng.choice(bad)
        docs.append((i, " ".join(words)))
        marks.append((i, toxic))
    rows = toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in rows if r.held_out]) > 0.95


def test_words_that_differ_after_their_opening(spark):
    """Compounds of one opening, and words of three-byte letters, whose later bytes alone are telling."""
    rng = random.Random(4)
    bad, good = ("kindergartenhasser", "ตกลงแย่มากจริง"), ("kindergartenfreund", "ตกลงดีมากเสมอ")
    docs, marks = [], []
    for i in range(600):
        toxic = int(i % 4 == 0)
        words = prose(i, 60).split()
        for _ in range(4):
            words[rng.randrange(60)] = rng.choice(bad if toxic else good)
        docs.append((i, " ".join(words)))
        marks.append((i, toxic))
    rows = toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in rows if r.held_out]) > 0.95
    for word in (b"x", b"ninebytes", b"tenbytes10", b"abcdefghi" * 3, bytes(range(97, 117))):
        at = [0, *range(9, len(word) - 9, 9), *([len(word) - 9] if len(word) > 9 else [])]
        assert [w.removeprefix(LATER) for w in windows_of(word)] == [word[i : i + 9] for i in at]


def test_classes_known_by_long_texts_alone(spark):
    """Texts past the learning bound are learned from, by a passage of each."""
    rng, docs, marks = random.Random(6), [], []
    for i in range(90):
        toxic = int(i % 3 == 0)
        words = prose(i, 9_000 if i < 80 else 200).split()
        for k in range(0, len(words) if toxic else 0, 25):
            words[k] = rng.choice(("grumbol", "snarfety"))
        docs.append((i, " ".join(words)))
        marks.append((i, toxic, toxic))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    assert all(len(t) > 48_000 for i, t in docs if i < 80)
    rows = toxicity(*frames).collect()
    assert np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in rows if r.held_out]) > 0.9
    assert len({round(r.score, 9) for r in quality(*frames).collect()}) > 1


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    marks = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in op10_quality(spark, folder).filter("held_out").collect() if r.doc_id in marks]
    assert np.mean([r.predicted == marks[r.doc_id]["quality"] for r in held]) > 0.98
    # About one labelled document in ten is toxic, so recall and precision are asserted, not accuracy.
    held = [r for r in op6_toxicity(spark, folder).filter("held_out").collect() if r.doc_id in marks]
    both = sum(r.predicted and marks[r.doc_id]["toxic"] for r in held)
    toxic, found = sum(marks[r.doc_id]["toxic"] for r in held), sum(r.predicted for r in held)
    assert both > 0.82 * toxic and both > 0.9 * found, (both, toxic, found)
