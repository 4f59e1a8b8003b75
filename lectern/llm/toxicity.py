"""Toxicity by compression distance to two zstandard dictionaries.

One dictionary is trained on ordinary text, one on what sets toxic text apart.
A text's windows are its distinct words, long ones in several pieces; each is
compressed with either, and the bytes that the toxic dictionary saves are held
against calibrated thresholds.  Windows go in a code of four pseudo-random bytes
a character and position, so that only whole shared beginnings of windows shorten
and entropy coding adds no noise.

What windows of single words cannot see: the order and number of words, so a
passage of ordinary words in a telling order; a telling part of a long word that
does not begin where a piece does; and a window that the toxic dictionary
compresses to more than the calibrated size, which counts as nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import held_out, labelled_sample
from .session import text_bytes
from .words import WordHasher, gram_hashes, multipliers

#: Labelled documents of either class that are learned from, and the characters of one (a passage of a longer text).
TRAIN_DOCS = 2500
TRAIN_CHARS = 48_000
OPENING = 9
SHORTEST = 4
DICTIONARY_BYTES = 8192
ORDINARY_BYTES = 24_576
#: A window counts if the toxic dictionary compresses it to so many bytes at most: which of these is calibrated, like the thresholds' weights, on labelled rows alone.
WHOLE = (30, 36, 48, 64)
THRESHOLDS = (3, 5, 7, 9, 11, 13, 15)
#: Parts of the labelled texts: each is scored by dictionaries of the others, which calibrates the thresholds.
FOLDS = 3
MEMO_LIMIT = 400_000
#: Starts a window that is not its word's opening; no word holds it.
LATER = b" "
_CODE = [[bytes(c) for c in position] for position in np.random.default_rng(5).integers(0, 256, (OPENING, 256, 4), dtype=np.uint8)]
_LATER_CODE = [[bytes(c) for c in position] for position in np.random.default_rng(8).integers(0, 256, (OPENING, 256, 4), dtype=np.uint8)]


def windows_of(word: bytes) -> list[bytes]:
    """A word's first OPENING bytes, then every further stretch of OPENING, the last one back from the word's end."""
    if len(word) <= OPENING:
        return [word]
    later = [LATER + word[i : i + OPENING] for i in range(OPENING, len(word) - OPENING, OPENING)]
    return [word[:OPENING], *later, LATER + word[-OPENING:]]


def word_windows(text: bytes | None) -> list[bytes]:
    """The windows of each lower-cased (A-Z) word."""
    return [w for word in (text or b"").lower().split() for w in windows_of(word)]


def coded(window: bytes) -> bytes:
    if window.startswith(LATER):
        return b"".join([_LATER_CODE[i][c] for i, c in enumerate(window[len(LATER) :])])
    return b"".join([_CODE[i][c] for i, c in enumerate(window)])


def beginnings(window: bytes) -> list[bytes]:
    """The window's first bytes, from SHORTEST of them to all, the longest first."""
    mark = len(LATER) if window.startswith(LATER) else 0
    return [window[:k] for k in range(len(window), mark + SHORTEST - 1, -1)]


#: The compressor looks for no match in an input's last bytes: these take their place.
_TAIL = np.random.default_rng(6).integers(0, 256, 16, dtype=np.uint8).tobytes()


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    whole: int
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


class Windows:
    """Compressed sizes of windows under the two dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        settings = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=16, chain_log=16, search_log=6, min_match=5, target_length=32, strategy=zstandard.STRATEGY_LAZY,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        # Both hold the ordinary text at the same distances; noise that nothing
        # matches stands in for the toxic part, so that only this part differs.
        noise = np.random.default_rng(0).integers(0, 256, len(toxic), dtype=np.uint8).tobytes()
        self.compressors = []
        for content in (ordinary + noise, ordinary + toxic):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=settings)
            self.compressors.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=held))
        self.memo: dict[bytes, int] = {}

    def sizes(self, windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(bytes that the toxic dictionary saves, compressed size under it) of each window."""
        memo, missing = self.memo, ()
        try:
            both = np.fromiter(map(memo.__getitem__, windows), np.int64, len(windows))
        except KeyError:
            missing = set(windows).difference(memo)
            plain, toxic = self.compressors
            for w in missing:
                data = coded(w) + _TAIL
                size = len(toxic.compress(data))
                memo[w] = (len(plain.compress(data)) - size) * 1024 + size
            both = np.fromiter(map(memo.__getitem__, windows), np.int64, len(windows))
        if len(memo) > MEMO_LIMIT:  # full: what came first stays
            for w in missing:
                del memo[w]
        return both >> 10, both & 1023

    def features(self, text: bytes | None, wholes: tuple[int, ...]) -> np.ndarray:
        """A row for each bound on the toxic dictionary's size."""
        words = [windows_of(w) for w in sorted(set((text or b"").lower().split()))]
        gain, size = self.sizes([w for windows in words for w in windows])
        edge = np.cumsum([0] + [len(windows) for windows in words[:-1]])
        n, out = math.sqrt(len(words) + 20), []
        for whole in wholes:
            saved = np.where(size <= whole, gain, 0)
            if words:  # a word saves what the best of its windows saves
                saved = np.maximum.reduceat(saved, edge)
            over = np.array([(saved >= t).sum() for t in THRESHOLDS], np.float64)
            out.append(np.concatenate([3 * over / n, np.log1p(over), [math.log1p(len(words)), saved[saved >= THRESHOLDS[0]].sum() / n]]))
        return np.array(out)


def _prefixes(text: bytes) -> set[bytes]:
    return {b for w in set(word_windows(text)) for b in beginnings(w)}


def _unlike(texts: list[str]) -> list[bytes]:
    """The texts without near copies of earlier ones (four of eight least shingle hashes alike): copies would count words twice."""
    hasher, odd, out = WordHasher(lower=True), multipliers(8, 17), []
    owners: dict[tuple[int, int], list[int]] = {}
    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        words = hasher(data)[2]
        grams = gram_hashes(words, min(5, max(1, len(words))))
        keys = [(k, int((grams * m).min())) for k, m in enumerate(odd)] if len(grams) else [(k, 0) for k in range(8)]
        alike = Counter(i for key in keys for i in owners.get(key, ()))
        if max(alike.values(), default=0) < 4:
            for key in keys:
                owners.setdefault(key, []).append(len(out))
            out.append(data)
    return out


def _dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=4 * OPENING + 4, d=8).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their content itself
        return b"".join(samples)[-size:]


def _dictionaries(plain: list[bytes], bad: list[bytes], usual: Counter, seen: Counter) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionaries of texts, given in how many of either class each beginning occurs."""
    n_plain, n_bad = len(plain), len(bad)

    def apart(w: bytes) -> bool:
        rate = (usual[w] + 1) / (n_plain + 1)
        return seen[w] >= max(5, n_bad / 100) and seen[w] - n_bad * rate > 6 * math.sqrt(n_bad * rate) and seen[w] / n_bad > 8 * (usual[w] + 0.5) / n_plain

    telling = {w for w in seen if apart(w)} if n_plain and n_bad else set()
    samples = []
    for t in bad:
        longest = [next((b for b in beginnings(w) if b in telling), b"") for w in word_windows(t)]
        if any(longest):
            samples.append(b"".join(map(coded, longest)))
    toxic = _dictionary(samples, DICTIONARY_BYTES) if samples else b""
    return toxic, _dictionary([b"".join(map(coded, word_windows(t))) for t in plain], ORDINARY_BYTES) if plain else b""


def _regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(centre, scale, weights, loss) of a ridge-regularised logistic regression by Newton steps."""
    centre = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    scale = x.std(axis=0) + 1e-9 if len(x) else np.ones(x.shape[1])
    a = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        w -= np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 0.3 * np.eye(len(w)), a.T @ (weight * (p - y)) + 0.3 * w)
    p = np.clip(1 / (1 + np.exp(-np.clip(a @ w, -40, 40))), 1e-6, 1 - 1e-6)
    return centre, scale, w, float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())


def fit(ordinary: list[str], toxic: list[str], share: float) -> Model:
    """Dictionaries of all texts given; the thresholds' weights from texts scored by dictionaries of the other folds.

    share: of toxic documents among the labelled ones; the sample is weighed back to it.
    """
    classes = [_unlike(ordinary), _unlike(toxic)]
    counts = [[Counter() for _ in range(FOLDS)] for _ in classes]
    for texts, parts in zip(classes, counts, strict=True):
        for k, t in enumerate(texts):
            parts[k % FOLDS].update(_prefixes(t))
    every = [sum(parts, Counter()) for parts in counts]
    x, y = [], []
    for f in range(FOLDS):
        others = [[t for k, t in enumerate(texts) if k % FOLDS != f] for texts in classes]
        windows = Windows(*_dictionaries(*others, *(total - parts[f] for total, parts in zip(every, counts, strict=True))))
        for label, texts in enumerate(classes):
            x += [windows.features(t, WHOLE) for t in texts[f::FOLDS]]
            y += [float(label)] * len(texts[f::FOLDS])
    x, y = np.array(x).reshape(len(y), len(WHOLE), 2 * len(THRESHOLDS) + 2), np.array(y)
    here = y.mean() if len(y) else 0.5
    weight = np.where(y > 0, share / max(here, 1e-9), (1 - share) / max(1 - here, 1e-9))
    fits = [_regression(x[:, k], y, weight) for k in range(len(WHOLE))]
    best = min(range(len(WHOLE)), key=lambda k: fits[k][3])
    centre, scale, w, _ = fits[best]
    return Model(*_dictionaries(*classes, *every), WHOLE[best], tuple(centre), tuple(scale), tuple(w))


@lru_cache(maxsize=2)
def _windows(toxic: bytes, ordinary: bytes) -> Windows:
    return Windows(toxic, ordinary)


def _score(model: Broadcast, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        windows = _windows(m.toxic, m.ordinary)
        centre, scale, weights = np.array(m.centre), np.array(m.scale), np.array(m.weights)
        for batch in batches:
            x = np.array([windows.features(t, (m.whole,))[0] for t in text_bytes(batch)]).reshape(batch.num_rows, len(centre))
            score = 1 / (1 + np.exp(-np.clip((x - centre) / scale @ weights[:-1] + weights[-1], -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, fold: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row.

    Learns from labels.toxic of documents outside the held-out fold (crc32 of
    doc_id as text, modulo ``modulus``, equal to ``fold``), at most TRAIN_DOCS of
    either class and a passage of TRAIN_CHARS characters of a longer one; a score reads every byte of the text, in windows within single
    words (see the module for what these cannot see), and nothing else.  Null and empty
    texts have no windows and score as such; without labels every score is 0.5.  A
    null doc_id is not held out; null or other labels are not learned from, and of
    two labels of one document both are.  Repeated rows each get their row; further
    columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1)").distinct()
    learn = texts.join(marks, "doc_id").filter(~held_out(F.col("doc_id"), modulus, fold))
    sample, counts = labelled_sample(learn, "toxic", TRAIN_DOCS, TRAIN_CHARS)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    model = fit(*([t for _, t in sample.get(k, [])] for k in (0, 1)), share)
    rows = texts.select("doc_id", F.col("text").cast("binary").alias("text"), held_out(F.col("doc_id"), modulus, fold).alias("held_out"))
    return rows.mapInArrow(_score(spark.sparkContext.broadcast(model), threshold), "doc_id long, held_out boolean, score double, predicted int")
