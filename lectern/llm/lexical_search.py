"""Ranked lexical search by MaxScore on shards of documents.

One pass counts documents, terms and the document frequencies of the queries'
terms.  In the second, every task builds an inverted index of one bounded shard of
its documents after another.  For each query the shard's terms are ordered by
their upper bounds: those whose bounds together stay under the query's k-th best
score so far are non-essential, only documents of the other lists are scored, and
the non-essential postings are probed, the largest bound first, only while a
document can still qualify.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import pieces, text_bytes
from .words import WordHasher

#: Bytes of query text in one pass; what is broadcast and collected stays in proportion.
ITEM_BYTES = 4_000_000
#: Bytes of text that one shard's index covers (a longer document goes alone).
SHARD_BYTES = 8_000_000
FILTER_BITS = 20
#: Tasks whose rows of one query are ranked together before all of them are.
TASKS_TOGETHER = 256
#: Letters A-Z and a-z, digits and all bytes of other characters make terms; the rest separates.
_SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
_NONE = (np.empty(0, np.int64),) * 2


class Items:
    """The queries of one pass and the terms that they hold."""

    def __init__(self, rows: Sequence[tuple[int, str]]):
        self.hasher = WordHasher(lower=True, separators=_SEPARATORS)
        self.ids = [i for i, _ in rows]
        bags: list[Counter[bytes]] = []
        known: dict[bytes, int] = {}
        for _, text in rows:
            data = text.encode("utf-8", "surrogatepass")
            starts, ends, hashes = self.hasher(data)
            terms = [data[a:b].lower() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            known.update(zip(terms, hashes.tolist(), strict=True))
            bags.append(Counter(terms))
        order = sorted(known, key=lambda t: (known[t], t))
        place = {t: k for k, t in enumerate(order)}
        self.hashes = np.array([known[t] for t in order], np.uint64)
        if len(np.unique(self.hashes)) < len(order):
            raise ValueError("two query terms of one hash")
        self.lengths = np.array([len(t) for t in order], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(order), np.uint8)
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self.hashes >> np.uint64(64 - FILTER_BITS)] = True
        self.bags = [(np.array([place[t] for t in bag], np.int64), np.array(list(bag.values()), np.int64)) for bag in bags]

    def __len__(self) -> int:
        return len(self.hashes)

    def terms(self, data: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, term) for the words of a buffer that are query terms, told by hash and then byte by byte."""
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(64 - FILTER_BITS)]) if len(self) else _NONE[0]
        if not len(at):
            return _NONE
        term = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self) - 1)
        size = ends[at] - starts[at]
        same = (self.hashes[term] == hashes[at]) & (self.lengths[term] == size)
        at, term, size = at[same], term[same], size[same]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        text = np.frombuffer(data, np.uint8)[np.repeat(starts[at], size) + within]
        text = np.where((text >= 65) & (text <= 90), text + 32, text)
        other = text != self.bytes[np.repeat(self.starts[term], size) + within]
        if other.any():
            fit = np.ones(len(at), bool)
            fit[np.repeat(np.arange(len(at)), size)[other]] = False
            at, term = at[fit], term[fit]
        return at, term

    def postings(self, texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, terms of each row, and row, query term, times of each posting) for runs of texts."""
        for at, _to, data, starts, ends, hashes, first in self.hasher.documents(texts):
            word, term = self.terms(data, starts, ends, hashes)
            row = np.searchsorted(first, word, side="right") - 1
            key, times = np.unique(row * max(1, len(self)) + term, return_counts=True)
            yield at, np.diff(first), key // max(1, len(self)), key % max(1, len(self)), times


@lru_cache(maxsize=1)
def items_of(rows: tuple[tuple[int, str], ...]) -> Items:
    """Built once in each worker process from the broadcast texts."""
    return Items(rows)


def _count(rows: Broadcast):
    """Of one partition: documents with a term (-1), their terms (-2), and documents with each query term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = items_of(rows.value)
        df, docs, length = np.zeros(len(items), np.int64), 0, 0
        for batch in pieces(batches):
            for _, n, _row, term, _times in items.postings(text_bytes(batch)):
                df += np.bincount(term, minlength=len(items))
                docs, length = docs + int((n > 0).sum()), length + int(n.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], some]), pa.int64()), pa.array(np.concatenate([[docs, length], df[some]]), pa.int64())], ["term", "n"])

    return run


class Shard:
    """An inverted index of some documents over the query terms: each term's documents, impacts and upper bound."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, row: np.ndarray, term: np.ndarray, times: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids = ids
        order = np.lexsort((row, term))
        norm = 100 - 75 + 75 * sizes * n_docs // n_terms
        self.row, times, term = row[order], times[order], term[order]
        self.impact = weights[term] * (1_000_000_000 * times // (1000 * times + 8 * norm[self.row]))
        self.begin = np.searchsorted(term, np.arange(len(weights) + 1))
        self.bound = np.zeros(len(weights), np.int64)
        held = np.flatnonzero(np.diff(self.begin))
        if len(held):
            self.bound[held] = np.maximum.reduceat(self.impact, self.begin[held])
        self.score = np.zeros(len(ids), np.int64)

    def search(self, terms: np.ndarray, repeats: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of all documents whose score is at least ``least`` (1 or more)."""
        bound = repeats * self.bound[terms]
        order = np.argsort(bound, kind="stable")
        order = order[bound[order] > 0]
        sums = np.concatenate([[0], np.cumsum(bound[order])])
        essential = int(np.searchsorted(sums[1:], least))  # the lists before it stay under ``least`` together
        if essential == len(order):
            return _NONE
        terms, repeats, score = terms[order].tolist(), repeats[order].tolist(), self.score
        lists = [slice(self.begin[t], self.begin[t + 1]) for t in terms]
        for part, times in zip(lists[essential:], repeats[essential:], strict=True):
            score[self.row[part]] += times * self.impact[part]
        seen = np.unique(np.concatenate([self.row[part] for part in lists[essential:]]))
        left = seen[score[seen] + sums[essential] >= least]
        for k in range(essential - 1, -1, -1):
            if not len(left):
                break
            rows = self.row[lists[k]]
            at = np.minimum(np.searchsorted(rows, left), len(rows) - 1)
            hit = rows[at] == left
            score[left[hit]] += repeats[k] * self.impact[lists[k]][at[hit]]
            left = left[score[left] + sums[k] >= least]
        found = score[left].copy()
        score[seen] = 0
        return left, found


def _rank(rows: Broadcast, stats: Broadcast, k: int):
    """The k best documents of one partition for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = items_of(rows.value)
        weights, n_docs, n_terms = stats.value
        held = [_NONE] * len(items.ids)
        parts: list[tuple[np.ndarray, ...]] = []
        size = total = 0

        def evaluate() -> None:
            nonlocal parts, size, total
            shard = Shard(*(np.concatenate(x) for x in zip(*parts, strict=True)), weights, n_docs, n_terms)
            for q, (terms, repeats) in enumerate(items.bags):
                ids, scores = held[q]
                found, new = shard.search(terms, repeats, max(1, int(scores[-1])) if len(ids) == k else 1)
                if len(found):
                    ids, scores = np.concatenate([ids, shard.ids[found]]), np.concatenate([scores, new])
                    best = np.lexsort((ids, -scores))[:k]
                    held[q] = ids[best], scores[best]
            parts, size, total = [], 0, 0

        for batch in pieces(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            texts = text_bytes(batch)
            for at, n, row, term, times in items.postings(texts):
                parts.append((ids[at : at + len(n)], n, row + total, term, times))
                total += len(n)
                size += sum(len(t or b"") for t in texts[at : at + len(n)])
                if size >= SHARD_BYTES:
                    evaluate()
        if parts:
            evaluate()
        columns = [np.repeat(np.array(items.ids, np.int64), [len(i) for i, _ in held]), *(np.concatenate([x[j] for x in held]) if held else _NONE[0] for j in (0, 1))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])

    return run


def _passes(items: DataFrame, item_bytes: int) -> Iterator[Broadcast]:
    """The queries in broadcasts of bounded size."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-int(total) // item_bytes))
    for k in range(passes):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).collect()
        yield items.sparkSession.sparkContext.broadcast(tuple(sorted((r.item_id, r.text) for r in rows)))


def _best(rows: DataFrame, k: int, *more: str) -> DataFrame:
    order = Window.partitionBy("item_id", *more).orderBy(F.desc("score"), F.asc("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, scores above 0 alone, ties to the smaller doc_id.

    Terms are runs of ASCII letters and digits and of all other characters from
    U+0080 on, A-Z lower-cased; whole texts count.  With N documents that have a
    term, L terms of them all, n of a document, df documents that hold a term and tf
    times in the document, a term weighs w = floor(1000 ln((2N + 2) / (2df + 1))),
    m = 25 + 75nN div L, and a document scores the sum of w * (10^9 tf div (1000 tf
    + 8m)) over the item's terms, repeats included, in 64-bit integers.

    Rows with a null id take no part, nor in the counts; null texts have no term;
    a repeated document is ranked as often as it stands there; of several texts of
    one item_id the smallest counts; items without a term of any document, empty
    tables and further columns give no rows.

    Items go in passes of bounded bytes.  What a pass broadcasts are its items and
    their terms' weights; documents are read twice and never shuffled, only each
    task's k best a query are.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).filter("doc_id IS NOT NULL")
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    found = None
    for rows in _passes(asked, item_bytes):
        counts = dict(map(tuple, texts.mapInArrow(_count(rows), "term long, n long").groupBy("term").agg(F.sum("n")).collect()))
        n_docs, n_terms = counts.pop(-1, 0), counts.pop(-2, 0)
        weights = np.zeros(len(items_of(rows.value)), np.int64)
        for term, df in counts.items():
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        stats = spark.sparkContext.broadcast((weights, n_docs, max(1, n_terms)))
        best = texts.mapInArrow(_rank(rows, stats, k), "item_id long, doc_id long, score long")
        some = _best(best.withColumn("tasks", F.floor(F.spark_partition_id() / TASKS_TOGETHER)), k, "tasks")
        found = some if found is None else found.unionByName(some)
    return _best(found.select("item_id", "doc_id", "score"), k).select("item_id", "rank", "doc_id", "score")
