"""Benchmark decontamination with SimHash windows of each item's size.

Windows as long as an item get a 64-bit SimHash of their weighted shingles.
A multi-index over the bits' blocks finds every item within the radius, and the
exact weighted-shingle similarity decides.  Windows that share no shingle with
any item of their size cannot reach a similarity above 0, so only those around a
shared shingle are fingerprinted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import pieces, text_bytes
from .words import WordHasher, gram_hashes, mix

SHINGLE = 5
THRESHOLD = 0.8
#: At a similarity of 0.8 the expected distance is under 10 of 64 bits (deviation 3).
RADIUS = 22
BLOCK_BITS = 8
#: Bytes of benchmark text in one pass; what is broadcast stays in proportion.
ITEM_BYTES = 32_000_000
FILTER_BITS = 20
#: Letters, digits and all bytes of other scripts make words; the rest separates.
_SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
_POPULAR = np.array([bin(i).count("1") for i in range(256)])


def simhash(votes: np.ndarray) -> np.ndarray:
    """64 bits of sums of votes (rows of 64)."""
    return np.packbits(votes > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


def votes_of(grams: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle hash."""
    bits = np.unpackbits(mix(grams).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


class HammingIndex:
    """Every fingerprint within the radius: some block then differs in at most radius // blocks bits."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.blocks = 64 // BLOCK_BITS
        near = RADIUS // self.blocks
        keys = np.arange(1 << BLOCK_BITS)
        close = _POPULAR[keys[:, None] ^ keys[None, :]] <= near
        self.lists = []
        for b in range(self.blocks):
            own = self._block(prints, b)
            hits = close[:, own]
            self.lists.append((np.concatenate([[0], np.cumsum(hits.sum(axis=1))]), np.nonzero(hits)[1]))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)

    def __call__(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) pairs within the radius, in blocks of queries."""
        found = []
        for at in range(0, len(prints), 4096):
            part, keys = prints[at : at + 4096], []
            for b, (start, items) in enumerate(self.lists):
                key = self._block(part, b)
                size = start[key + 1] - start[key]
                query = np.repeat(np.arange(len(part)), size)
                offset = np.arange(len(query)) - np.repeat(np.cumsum(size) - size, size)
                keys.append(query * len(self.prints) + items[np.repeat(start[key], size) + offset])
            pair = np.unique(np.concatenate(keys))
            query, item = pair // len(self.prints), pair % len(self.prints)
            near = np.bitwise_count(part[query] ^ self.prints[item]) <= RADIUS
            found.append((query[near] + at, item[near]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2  # type: ignore[return-value]


class Items:
    """The items of one pass, by size."""

    def __init__(self, rows: Sequence[tuple[int, str]]):
        hasher = WordHasher(lower=True, separators=_SEPARATORS)
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, text in rows:
            words = hasher(text.encode("utf-8", "surrogatepass"))[2]
            if len(words):
                n = min(SHINGLE, len(words))
                by_size.setdefault(len(words), []).append((item_id, gram_hashes(words, n, seed=60_000 + n)))
        self.sizes = {}
        for size, items in sorted(by_size.items()):
            prints = np.concatenate([simhash(votes_of(g).sum(axis=0, dtype=np.int64)[None, :]) for _, g in items])
            self.sizes[size] = (np.array([i for i, _ in items]), [np.sort(g) for _, g in items], HammingIndex(prints), np.unique(np.concatenate([g for _, g in items])))
        self.filters = {}
        for n in {min(SHINGLE, size) for size in self.sizes}:
            every = np.unique(np.concatenate([x[3] for size, x in self.sizes.items() if min(SHINGLE, size) == n]))
            table = np.zeros(1 << FILTER_BITS, bool)
            table[every >> np.uint64(64 - FILTER_BITS)] = True
            self.filters[n] = (table, every)


@lru_cache(maxsize=1)
def items_of(rows: tuple[tuple[int, str], ...]) -> Items:
    """Built once in each worker process from the broadcast texts."""
    return Items(rows)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger counts of two sorted shingle lists."""
    values, counts_a = np.unique(a, return_counts=True)
    other, counts_b = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(other, values), len(other) - 1)
    same = np.minimum(counts_a, np.where(other[at] == values, counts_b[at], 0)).sum()
    return float(same / (len(a) + len(b) - same))


def _windows(grams: np.ndarray, size: int, hits: np.ndarray, words: int, reach: int) -> np.ndarray:
    """Starts of the windows of ``size`` words that hold a shared shingle (reach: shingles in a window)."""
    mark = np.zeros(words + 2, np.int32)
    np.add.at(mark, np.maximum(0, hits - reach + 1), 1)
    np.add.at(mark, hits + 1, -1)
    starts = np.flatnonzero(np.cumsum(mark) > 0)
    return starts[starts <= words - size]


def shared_shingles(table: np.ndarray, every: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Positions of the shingles that some item has."""
    maybe = np.flatnonzero(table[grams >> np.uint64(64 - FILTER_BITS)])
    if len(maybe):
        at = np.minimum(np.searchsorted(every, grams[maybe]), len(every) - 1)
        maybe = maybe[every[at] == grams[maybe]]
    return maybe


def leaks(items: Items, hashes: np.ndarray, grams: dict[int, np.ndarray]) -> list[tuple[int, float, int, int]]:
    """(item_id, similarity, first word, end word) of the best window for each item found in a document."""
    out = []
    shared = {n: shared_shingles(table, every, grams[n]) for n, (table, every) in items.filters.items()}
    for size, (ids, sets, index, own) in items.sizes.items():
        n = min(SHINGLE, size)
        hits, g = shared[n], grams[n]
        # A document shorter than the item is one window, unless too few of the item's shingles are left.
        short = size > len(hashes)
        if not len(hits) or (short and len(g) < THRESHOLD * (size - n + 1)):
            continue
        at = np.minimum(np.searchsorted(own, g[hits]), len(own) - 1)
        hits = hits[own[at] == g[hits]]
        reach = len(g) if short else size - n + 1
        starts = np.zeros(min(1, len(hits)), np.int64) if short else _windows(g, size, hits, len(hashes), reach)
        if not len(starts):
            continue
        # Runs of neighbouring windows share one prefix sum of votes.
        gap = np.flatnonzero(np.diff(starts) > reach) + 1
        best: dict[int, tuple[float, int]] = {}
        for run in np.split(starts, gap):
            for k in range(0, len(run), 16_384):
                some = run[k : k + 16_384]
                lo, hi = int(some[0]), int(some[-1]) + reach
                sums = np.zeros((hi - lo + 1, 64), np.int32)
                np.cumsum(votes_of(g[lo:hi]), axis=0, dtype=np.int32, out=sums[1:])
                prints = simhash(sums[some - lo + reach] - sums[some - lo])
                for q, i in zip(*(x.tolist() for x in index(prints)), strict=True):
                    start = int(some[q])
                    value = weighted_similarity(sets[i], np.sort(g[start : start + reach]))
                    if value >= THRESHOLD and value > best.get(i, (0.0, 0))[0]:
                        best[i] = (value, start)
        out += [(int(ids[i]), value, start, min(start + size, len(hashes))) for i, (value, start) in sorted(best.items())]
    return out


def _found(items: Items, hasher: WordHasher, texts: list[bytes | None]) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item_id, similarity, first word, end word) for a batch of texts."""
    for at, _to, _data, _s, _e, hashes, first in hasher.documents(texts):
        whole = {n: gram_hashes(hashes, n, seed=60_000 + n) for n in items.filters}
        # Documents without a shared shingle are passed over at once.
        busy = [shared_shingles(table, every, whole[n]) for n, (table, every) in items.filters.items()]
        for d in np.unique(np.searchsorted(first, np.concatenate(busy), side="right") - 1) if busy else ():
            lo, hi = int(first[d]), int(first[d + 1])
            own = {n: g[lo : max(lo, hi - n + 1)] for n, g in whole.items()}
            for leak in leaks(items, hashes[lo:hi], own):
                yield (int(at + d), *leak)


def _search(rows: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, hasher = items_of(rows.value), WordHasher(lower=True, separators=_SEPARATORS)
        for batch in pieces(batches):
            ids = batch.column("doc_id").to_pylist()
            found = [(ids[row], *rest) for row, *rest in _found(items, hasher, text_bytes(batch))]
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "similarity", "first_word", "end_word"])

    return run


def _drop(rows: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, hasher = items_of(rows.value), WordHasher(lower=True, separators=_SEPARATORS)
        for batch in pieces(batches):
            keep = np.ones(batch.num_rows, bool)
            for row, *_ in _found(items, hasher, [None if t is None else t.encode("utf-8", "surrogatepass") for t in text_bytes(batch)]):
                keep[row] = False
            yield batch.filter(pa.array(keep))

    return run


def _passes(benchmark: DataFrame, item_bytes: int) -> Iterator[Broadcast]:
    """The benchmark's items in broadcasts of bounded size."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-int(total) // item_bytes))
    for k in range(passes):
        rows = [(r.item_id, r.text) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).distinct().collect()]
        yield benchmark.sparkSession.sparkContext.broadcast(tuple(sorted(rows)))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of docs, unchanged, in whose text ``contaminated`` finds no item; nothing is shuffled.

    Null, empty and wordless texts stay, and so do null ids and repeated rows whose
    text is clean (a null id is judged by its text); columns of any other name stay;
    an empty benchmark drops nothing and no rows give no rows.
    """
    for rows in _passes(benchmark, item_bytes):
        docs = docs.mapInArrow(_drop(rows), docs.schema)
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """doc_id, item_id, similarity, first_word, end_word: the best window of each item found in a document.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.  A
    window has as many words as the item, or all words of a shorter document; similarity is the weighted (multiset)
    Jaccard of their five-word shingles and at least 0.8; an item of fewer words is
    one shingle.  Ties go to the earliest window.  Null, empty or wordless texts and
    items, and null ids, take no part; repeated documents repeat their rows, repeated
    items count once; further columns are ignored; no rows give no rows.

    The benchmark is a stated query set and goes in passes of bounded size.
    """
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    schema = "doc_id long, item_id long, similarity double, first_word long, end_word long"
    found = None
    for rows in _passes(benchmark, item_bytes):
        some = texts.mapInArrow(_search(rows), schema)
        found = some if found is None else found.unionByName(some)
    return found
