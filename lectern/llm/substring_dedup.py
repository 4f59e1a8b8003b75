"""Removal of word passages that an earlier document already has.

Every window of consecutive words has an anchor, the least hash of its short
grams, so equal windows meet at equal anchors and far fewer rows than words are
shuffled to find what recurs.  Windows at recurring anchors are confirmed by
their own hashes.  Documents then stream, group by group, through Aho-Corasick
automata of their recurring passages, which locate every occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import shuffle_partitions, text_bytes, tidy
from .words import WordHasher, gram_hashes

WINDOW = 13
GRAM = 6
#: Bits of the filter of recurring anchors: 32 MB at every input size.  A fuller
#: filter lets more windows through to the confirmation and loses none.
FILTER_BITS = 28
SHARD_BYTES = 8_000_000
GROUP_WORDS = 200_000


def _windows(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, document) of the windows of a batch that lie within one document."""
    size = np.diff(first)
    limit = np.repeat(first[1:], size)
    starts = np.flatnonzero(np.arange(len(hashes)) + WINDOW <= limit)
    return starts, np.repeat(np.arange(len(size)), size)[starts]


def _anchors(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    grams = gram_hashes(hashes, GRAM)
    m = len(hashes) - WINDOW + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    least = grams[:m].copy()
    for j in range(1, WINDOW - GRAM + 1):
        np.minimum(least, grams[j : j + m], out=least)
    return least[starts]


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their least and greatest value."""
    order = np.argsort(keys, kind="stable")
    k, v = keys[order], values[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    if not len(at):
        return k, v, v
    return k[at], np.minimum.reduceat(v, at), np.maximum.reduceat(v, at)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct anchors of a batch, and whether two of its documents have it."""
    hasher = WordHasher()
    for batch in batches:
        keys, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for at, _to, _data, _s, _e, hashes, first in hasher.documents(text_bytes(batch)):
            starts, doc = _windows(hashes, first)
            a = _anchors(hashes, starts)
            if len(a):
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
                keys.append(a[new])
                owners.append(doc[new] + at)
        key, low, high = _grouped(np.concatenate(keys), np.concatenate(owners))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(1 + (low < high).astype(np.int32))], ["anchor", "n"])


class RecurringFilter:
    """Membership of an anchor in the fixed-size bitmap of recurring ones (no false negatives)."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, np.uint64)
        self.shift = np.uint64(64 - (8 * len(bits)).bit_length() + 1)

    def __call__(self, anchors: np.ndarray) -> np.ndarray:
        slot = anchors >> self.shift
        return (self.bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def _candidates(hasher: WordHasher, known: RecurringFilter, texts: list[bytes | None]):
    """(first document of the piece, window hashes, window documents) of windows at recurring anchors."""
    for at, _to, _data, _s, _e, hashes, first in hasher.documents(texts):
        starts, doc = _windows(hashes, first)
        if len(starts):
            hit = known(_anchors(hashes, starts))
            if hit.any():
                yield at, gram_hashes(hashes, WINDOW)[starts[hit]], doc[hit]


def _window_rows(bitmap: Broadcast, for_shards: bool):
    """Candidate windows: each once for a shard and batch with its greatest document, or once for a batch with its least and greatest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = WordHasher(), RecurringFilter(bitmap.value)
        for batch in batches:
            ids, shards = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "shard"))
            keys, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for at, windows, doc in _candidates(hasher, known, text_bytes(batch)):
                keys.append(windows)
                owners.append(doc + at)
            key, owner = np.concatenate(keys), np.concatenate(owners)
            if for_shards:
                order = np.lexsort((shards[owner], key))
                key, shard, doc_id = key[order], shards[owner][order], ids[owner][order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])
                at = np.flatnonzero(new)
                high = np.maximum.reduceat(doc_id, at) if len(at) else doc_id
                yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(shard[at].astype(np.int32)), pa.array(high)], ["window", "shard", "high"])
            else:
                key, low, high = _grouped(key, ids[owner])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(low), pa.array(high)], ["window", "low", "high"])

    return run


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _text_rows(bitmap: Broadcast):
    """Texts with a candidate window go on to their shard, compressed; the others are done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = WordHasher(), RecurringFilter(bitmap.value)
        for batch in batches:
            texts = text_bytes(batch)
            busy = np.zeros(len(texts), bool)
            for at, _windows_found, doc in _candidates(hasher, known, texts):
                busy[doc + at] = True
            go, n, done = [], [], []
            for text, wait in zip(texts, busy.tolist(), strict=True):
                words = None if wait else (text or b"").split()
                go.append(zstandard.compress(text, 3) if wait else None)
                n.append(None if wait else len(words))
                done.append(None if wait else _digest(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), pa.array(go, pa.binary()), pa.array(n, pa.int64()), pa.array(done, pa.string())], ["doc_id", "shard", "text", "n_words", "kept_sha256"])

    return run


def _passages(rows: list[list[int]], words: list[np.ndarray], windows: np.ndarray, firsts: np.ndarray) -> dict[tuple[int, ...], np.ndarray]:
    """(word sequence, first documents of its windows) of each distinct maximal recurring passage of a group."""
    seen: dict[tuple[int, ...], np.ndarray] = {}
    if not len(windows):
        return seen
    for hashes, ids in zip(words, rows, strict=True):
        w = gram_hashes(hashes, WINDOW)
        if not len(w):
            continue
        at = np.minimum(np.searchsorted(windows, w), len(windows) - 1)
        hit = np.flatnonzero(windows[at] == w)
        if not len(hit):
            continue
        for run in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):
            a, b = int(run[0]), int(run[-1])
            seen.setdefault(tuple(ids[a : b + WINDOW]), firsts[at[a : b + 1]])
    return seen


def _locate(group: list[tuple[int, bytes]], windows: np.ndarray, firsts: np.ndarray, hasher: WordHasher) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """(doc_id, words, removed, kept words) for a group of documents, through one automaton."""
    import ahocorasick

    numbers: dict[bytes, int] = {}
    split = [text.split() for _, text in group]
    ids = [[numbers.setdefault(w, len(numbers)) for w in words] for words in split]
    hashes = [hasher(text)[2] for _, text in group]
    passages = _passages(ids, hashes, windows, firsts)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    owners = list(passages.values())
    for k, words in enumerate(passages):
        automaton.add_word(words, k)
    if owners:
        automaton.make_automaton()
    for (doc_id, _), words, own in zip(group, split, ids, strict=True):
        step = np.zeros(len(words) + 1, np.int32)
        for end, k in automaton.iter(tuple(own)) if owners and own else ():
            size = len(owners[k])  # windows of the passage
            late = np.flatnonzero(owners[k] < doc_id) + (end + 2 - WINDOW - size)
            np.add.at(step, late, 1)
            np.add.at(step, late + WINDOW, -1)
        gone = np.cumsum(step[:-1]) > 0
        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
        yield doc_id, len(words), int(gone.sum()), kept


def _strip(with_text: bool):
    def run(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        hasher = WordHasher()
        windows, low, _ = _grouped(found["window"].to_numpy().view(np.uint64), found["first"].to_numpy())
        out = []
        waiting = docs["text"].notna().to_numpy()
        done = docs[~waiting]
        group, size = [], 0
        for doc_id, packed in zip(docs["doc_id"][waiting], docs["text"][waiting], strict=True):
            text = zstandard.decompress(packed)
            group.append((int(doc_id), text))
            size += len(text) // 6
            if size >= GROUP_WORDS:
                out += [(i, n, gone, _digest(kept), b" ".join(kept) if with_text else None) for i, n, gone, kept in _locate(group, windows, low, hasher)]
                group, size = [], 0
        if group:
            out += [(i, n, gone, _digest(kept), b" ".join(kept) if with_text else None) for i, n, gone, kept in _locate(group, windows, low, hasher)]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
        rest = pd.DataFrame({"doc_id": done["doc_id"], "n_words": done["n_words"].astype("int64"), "n_removed": 0, "kept_sha256": done["kept_sha256"], "kept": None})
        both = pd.concat([rest, pd.DataFrame(out, columns=names)], ignore_index=True) if out else rest
        return both[names if with_text else names[:4]]

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the words left, for documents with a recurring window).

    Words are runs outside ``\\x20 \\x09-\\x0D``, unchanged.  A window is 13 words of
    one document; each word covered by a window that also starts in a document of a
    smaller doc_id goes.  Windows are judged on the input.  Null texts have no words;
    documents under 13 words keep all; rows with a null doc_id take no part and are
    not returned; repeated rows each get their row, and rows of one doc_id do not
    remove each other's words; further columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).filter("doc_id IS NOT NULL")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    with tidy(spark):
        anchors = texts.mapInArrow(_anchor_rows, "anchor long, n int")
        recurring = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1")
        slot = F.shiftrightunsigned("anchor", 64 - FILTER_BITS)
        words = recurring.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, CAST(shiftrightunsigned(anchor, %d) & 63 AS INT))" % (64 - FILTER_BITS)).alias("bit"))
        filled = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bitmap[filled.column("word").to_numpy()] = filled.column("bits").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bitmap.tobytes())
    shards = max(shuffle_partitions(spark), -(-int(size) // SHARD_BYTES))
    dealt = texts.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    rows = dealt.mapInArrow(_window_rows(shared, False), "window long, low long, high long")
    confirmed = rows.groupBy("window").agg(F.min("low").alias("first"), F.max("high").alias("last")).filter("first < last")
    sent = dealt.mapInArrow(_window_rows(shared, True), "window long, shard int, high long").join(confirmed.select("window", "first"), "window")
    sent = sent.filter("first < high").select("window", "shard", "first")  # a shard with nothing to remove needs no row
    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept binary" if with_text else "")
    waiting = dealt.mapInArrow(_text_rows(shared), "doc_id long, shard int, text binary, n_words long, kept_sha256 string")
    return waiting.groupBy("shard").cogroup(sent.groupBy("shard")).applyInPandas(_strip(with_text), kinds)
