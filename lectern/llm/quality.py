"""Text quality by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage is encoded by the words it holds
(hashed into buckets, whose projection is learned) and by its shape, a gated
attention learned from document labels weighs them, and the weighted
representation is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import held_out, labelled_sample
from .session import pieces, text_bytes
from .words import WordHasher

#: Labelled documents of either class that are learned from, and the characters of one (a passage of a longer text).
TRAIN_DOCS = 2000
TRAIN_CHARS = 20_000
PASSAGE = 64
HIDDEN, ATTENTION = 16, 8
EPOCHS, RATE, DECAY = 200, 0.02, 1e-3
#: Buckets that the words of a passage are hashed into, each with a sign.
BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS


def _table(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_CLASSES = (
    _table(bytes(range(65, 91))),
    _table(bytes(range(97, 123))),
    _table(bytes(range(48, 58))),
    _table(b".,;:?'\"()-"),
    _table(bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:?'\"()-")),
    _table(bytes(range(128, 256))),
    _table(b"\n"),
)
SHAPE = len(_CLASSES) + 9
FEATURES = SHAPE + BUCKETS


def encode(hasher: WordHasher, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and the number of passages of each text (1 for a wordless one)."""
    rows, counts = [], np.ones(len(texts), np.int64)
    for at, to, data, starts, ends, hashes, first in hasher.documents(texts):
        size = np.diff(first)
        n = np.maximum(1, -(-size // PASSAGE))
        counts[at:to] = n
        begin = np.repeat(first[:-1], n) + PASSAGE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        end = np.minimum(begin + PASSAGE, np.repeat(first[1:], n))
        x = np.zeros((len(begin), FEATURES), np.float32)
        full = np.flatnonzero(end > begin)
        if len(full):
            b, e = begin[full], end[full]
            words = (e - b).astype(np.float64)
            lo, hi = starts[b], ends[e - 1]
            chars = (hi - lo).astype(np.float64)
            buf = np.frombuffer(data, np.uint8)
            for k, table in enumerate(_CLASSES):
                sums = np.concatenate([[0], np.cumsum(table[buf], dtype=np.int64)])
                x[full, k] = (sums[hi] - sums[lo]) / chars
            length = (ends - starts).astype(np.float64)
            owner = np.repeat(np.arange(len(full)), (e - b))
            word = np.concatenate([np.arange(p, q) for p, q in zip(b, e, strict=True)]) if len(b) < 2 or (b[1:] != e[:-1]).any() else np.arange(b[0], e[-1])
            total = lambda v: np.bincount(owner, v, len(full))
            mean = total(length[word]) / words
            again = np.zeros(len(hashes), bool)
            again[1:] = hashes[1:] == hashes[:-1]
            order = np.lexsort((hashes[word], owner))
            h, o = hashes[word][order], owner[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
            k = len(_CLASSES)
            x[full, k] = mean / 10
            x[full, k + 1] = np.sqrt(np.maximum(0, total(length[word] ** 2) / words - mean**2)) / 10
            x[full, k + 2] = total(again[word].astype(np.float64)) / words
            x[full, k + 3] = np.bincount(o, fresh, len(full)) / words
            x[full, k + 4] = total((length[word] <= 3).astype(np.float64)) / words
            x[full, k + 5] = total((length[word] > 14).astype(np.float64)) / words
            x[full, k + 6] = total((length[word] == 1).astype(np.float64)) / words
            x[full, k + 7] = np.log1p(words) / 5
            x[full, k + 8] = np.log1p(np.repeat(size, n)[full]) / 10
            said = hashes[word]
            bucket = (said >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) + BUCKETS * owner
            sign = 1.0 - 2.0 * ((said >> np.uint64(63 - BUCKET_BITS)) & np.uint64(1)).astype(np.float64)
            x[full, SHAPE:] = np.bincount(bucket, sign, BUCKETS * len(full)).reshape(-1, BUCKETS) / np.sqrt(words)[:, None]
        rows.append(x)
    return np.concatenate(rows) if rows else np.zeros((0, FEATURES), np.float32), counts


class AttentionModel:
    """Gated attention over a bag's encoded passages."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.centre, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        spread = np.where(np.arange(FEATURES) < SHAPE, 0.3, 0.03)[:, None]
        self.p = {
            "w": r.normal(0, 1, (FEATURES, HIDDEN)) * spread, "b": np.zeros(HIDDEN), "v": r.normal(0, 0.3, (HIDDEN, ATTENTION)), "u": r.normal(0, 0.3, (HIDDEN, ATTENTION)),
            "a": r.normal(0, 0.3, ATTENTION), "c": r.normal(0, 0.3, HIDDEN), "d": np.zeros(1),
        }

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, tuple]:
        p, first = self.p, np.cumsum(counts) - counts
        h = np.tanh(x @ p["w"] + p["b"])
        tv, su = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (tv * su) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), counts))
        weight = e / np.repeat(np.add.reduceat(e, first), counts)
        z = np.add.reduceat(weight[:, None] * h, first, axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -40, 40)))
        return score, (h, tv, su, weight, z, first)

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        score, (h, tv, su, weight, z, first) = self.forward(x, counts)
        g = (score - y) / len(y)
        gz = np.repeat(g[:, None] * p["c"], counts, axis=0)
        pull = (gz * h).sum(axis=1)
        ge = weight * (pull - np.repeat(np.add.reduceat(weight * pull, first), counts))
        gate = ge[:, None] * p["a"]
        gv, gu = gate * su * (1 - tv**2), gate * tv * su * (1 - su)
        gh = (weight[:, None] * gz + gv @ p["v"].T + gu @ p["u"].T) * (1 - h**2)
        return {"w": x.T @ gh, "b": gh.sum(axis=0), "v": h.T @ gv, "u": h.T @ gu, "a": (tv * su).T @ ge, "c": z.T @ g, "d": np.array([g.sum()])}

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> AttentionModel:
        """Adam on the whole bounded sample."""
        if not len(y):
            return self
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        # Buckets keep their own proportions: a rare word's is not blown up.
        self.centre[SHAPE:], self.scale[SHAPE:] = 0.0, np.sqrt(np.mean(x[:, SHAPE:] ** 2)) + 1e-6
        x = self._scaled(x)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, EPOCHS + 1):
            for k, g in self.gradients(x, counts, y).items():
                g = g + DECAY * self.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] = self.p[k] - RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
        return self

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward(self._scaled(x), counts)[0] if len(counts) else np.zeros(0)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre.astype(x.dtype)) / self.scale.astype(x.dtype)).astype(x.dtype)


def _score(model: Broadcast, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, learned = WordHasher(), model.value
        for batch in pieces(batches):
            score = learned.score(*encode(hasher, text_bytes(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return run


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row.

    Learns from labels.quality of documents outside the held-out fold (crc32 of
    doc_id as text, modulo ``modulus``, equal to ``fold``), at most TRAIN_DOCS of
    either class and a passage of TRAIN_CHARS characters of a longer one; a score
    reads the whole text, by passages of PASSAGE words, and nothing else.  A null, empty or wordless text is one
    empty passage; without labels scores come from the untrained model.  A null doc_id is not held out;
    null or other labels are not learned from, and of two labels of one document
    both are.  Repeated rows each get their row; further columns are ignored; no
    rows give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality IN (0, 1)").distinct()
    learn = texts.join(marks, "doc_id").filter(~held_out(F.col("doc_id"), modulus, fold))
    sample, _ = labelled_sample(learn, "quality", TRAIN_DOCS, TRAIN_CHARS)
    bags = [(t.encode("utf-8", "surrogatepass"), float(k)) for k, rows in sample.items() for _, t in rows]
    x, counts = encode(WordHasher(), [t for t, _ in bags])
    model = AttentionModel().fit(x, counts, np.array([y for _, y in bags]))
    rows = texts.select("doc_id", F.col("text").cast("binary").alias("text"), held_out(F.col("doc_id"), modulus, fold).alias("held_out"))
    return rows.mapInArrow(_score(spark.sparkContext.broadcast(model), threshold), "doc_id long, held_out boolean, score double, predicted int")
