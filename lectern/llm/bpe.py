"""Byte-level BPE encoding and decoding on padded numpy matrices.

Pre-tokens of a batch are cut with array passes over code points, distinct
ones are bucketed by length, and every row of a bucket's matrix merges its
leftmost minimum-rank pair each round; finished rows are compacted away.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import pieces
from .tokenizer_files import vocabulary_path
from .words import mix

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Matrix widths; a longer pre-token takes the heap, which merges the same pair each time in n log n.
WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128, 256)
MEMO_LIMIT = 250_000
NONE = np.int64(1 << 40)


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of each code point: white space, L*, N* or other."""
    classes = np.full(0x110000, OTHER, np.int8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.finditer(pattern, every):
            classes[np.array(list(map(ord, run[0])))] = kind
    return classes


def pre_tokens(text: str) -> list[str]:
    """The matches of the tokenizer's split pattern, in order; together they are the text.

    Same cuts as the pattern: a run of one class with at most one leading blank;
    a white-space run leaves its last character to what follows it; an apostrophe
    that opens a token and precedes s, t, re, ve, m, ll or d goes with it.
    """
    n = len(text)
    if n == 0:
        return []
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = character_classes()[code]
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    blank = kind == SPACE
    begin = change.copy()
    # A white-space run gives its last character to the next token if that is a
    # plain blank, and else cuts it off as a token of its own.
    starts = np.flatnonzero(change & ~blank)
    starts = starts[starts > 0]
    starts = starts[blank[starts - 1]]
    last = starts - 1
    begin[last] = True
    begin[starts[code[last] == 0x20]] = False
    # Contractions, where the apostrophe opens its token.
    marks = np.flatnonzero((code == 0x27) & begin)
    for at in marks[marks + 1 < n].tolist():
        two = text[at + 1 : at + 3]
        size = 1 if two[0] in "stmd" else 2 if two in ("re", "ve", "ll") else 0
        if size:
            begin[at + 1 : at + 1 + size] = False
            if at + 1 + size < n and not begin[at + 1 + size]:
                begin[at + 1 + size] = True
    edges = np.flatnonzero(begin).tolist()
    edges.append(n)
    return [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of their merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 3))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        todo = np.arange(len(key))
        slot = self._slot(key)
        while len(todo):
            free = self.keys[slot[todo]] == -1
            spot = slot[todo[free]]
            first = np.unique(spot, return_index=True)[1]
            put = todo[free][first]
            self.keys[slot[put]], self.values[slot[put]] = key[put], merged[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair, NONE where there is none (ids below 0 never merge)."""
        key = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        slot = self._slot(key)
        out = np.full(len(key), NONE, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        while len(todo):
            seen = self.keys[slot[todo]]
            hit = seen == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (seen != -1)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out


class ByteBpe:
    """Encoder and decoder over a rank file."""

    def __init__(self, path: str):
        ranks = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        # Every split of a token into two tokens is a pair that merges into it.
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int64))
        self.memo: dict[str, bytes] = {}

    def _merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        """Rounds over one padded matrix, stored a column of cells after another.

        Each round finds every row's smallest pair rank (leftmost of equals),
        closes the gap of the merged cell, looks up the two new pairs, and drops
        the rows that have no pair left.
        """
        count = len(words)
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(count, width)
        size = np.array([len(w) for w in words], np.int32)
        ids = np.full((width + 1, count), -1, np.int32)
        ids[:width] = np.where(np.arange(width) < size[:, None], self.byte_id[raw], -1).T
        column = np.arange(width + 1, dtype=np.int64)[:, None]
        rank = self.pairs(ids[:-1].ravel(), ids[1:].ravel()).reshape(width, count)
        out: list[bytes] = [b""] * count
        alive = np.arange(count)
        while True:
            key = ((rank << 9) | column[: len(rank)]).min(axis=0)
            low = key >> 9
            done = low >= NONE
            if done.any():
                ended = np.flatnonzero(done)
                packed = np.ascontiguousarray(ids[:, ended].T).astype("<u4").tobytes()
                step = 4 * len(ids)
                for k, (at, cells) in enumerate(zip(alive[ended].tolist(), size[ended].tolist(), strict=True)):
                    out[at] = packed[k * step : k * step + 4 * cells]
                keep = np.flatnonzero(~done)
                if not len(keep):
                    return out
                alive, size, key, low = alive[keep], size[keep], key[keep], low[keep]
                cells = int(size.max()) + 1
                ids, rank = ids[:cells, keep], rank[: cells - 1, keep]
            best = key & 511
            row = np.arange(len(alive))
            ids = np.where(column[: len(ids) - 1] <= best, ids[:-1], ids[1:])
            ids[best, row] = low
            ids = np.concatenate([ids, np.full((1, len(alive)), -1, np.int32)]) if len(ids) < 2 else ids
            size = size - 1
            if len(ids) - 1 < int(size.max()):
                ids = np.concatenate([ids, np.full((1, len(alive)), -1, np.int32)])
            rank = np.where(column[: len(rank) - 1] < best, rank[:-1], rank[1:]) if len(rank) > 1 else np.full((1, len(alive)), NONE)
            if len(rank) < len(ids) - 1:
                rank = np.concatenate([rank, np.full((1, len(alive)), NONE)])
            following = np.minimum(best + 1, len(ids) - 1)
            right = self.pairs(ids[best, row], np.where(following > best, ids[following, row], -1))
            inside = best < len(rank)
            rank[best[inside], row[inside]] = right[inside]
            before = np.flatnonzero(best > 0)
            rank[best[before] - 1, before] = self.pairs(ids[best[before] - 1, before], low[before])

    def _merge_long(self, word: bytes) -> bytes:
        """The same merges for one very long pre-token: smallest rank first, leftmost of those."""
        ids = [int(self.byte_id[b]) for b in word]
        bytes_of, ranks = self.bytes_of, self.ranks
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get(bytes_of[ids[i]] + bytes_of[ids[i + 1]])
            if r is not None:
                heap.append((r, i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                k = ranks.get(bytes_of[r] + bytes_of[ids[nxt[i]]])
                if k is not None:
                    heapq.heappush(heap, (k, i, r, ids[nxt[i]]))
            if prv[i] >= 0:
                p = prv[i]
                k = ranks.get(bytes_of[ids[p]] + bytes_of[r])
                if k is not None:
                    heapq.heappush(heap, (k, p, ids[p], r))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        size = np.array([len(w) for w in words])
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((size > low) & (size <= width))
            for k in range(0, len(rows), 65_536 * 4 // width):
                part = rows[k : k + 65_536 * 4 // width].tolist()
                for i, ids in zip(part, self._merge_rows([words[i] for i in part], max(2, width)), strict=True):
                    out[i] = ids
            low = width
        for i in np.flatnonzero(size > low).tolist():
            out[i] = self._merge_long(words[i])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, packed likewise."""
        memo = self.memo
        split = [pre_tokens(t) for t in texts]
        missing = list(set().union(*split).difference(memo))
        memo.update(zip(missing, self.encode_words([w.encode("utf-8", "surrogatepass") for w in missing]), strict=True))
        out = [b"".join(map(memo.__getitem__, words)) for words in split]
        if len(memo) > MEMO_LIMIT:  # full: what came first, the frequent words among it, stays
            for w in missing:
                del memo[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    """One encoder for each worker process and vocabulary."""
    return ByteBpe(path)


def _encode(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in pieces(batches):
            ids = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
            columns = [
                batch.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def bpe_encode(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids on request): one row per input row.

    Whole texts by the ranks of ``vocabulary`` (a rank file's path), each match
    of the split pattern by itself, no special tokens; then decoded again.  Null
    text counts as empty (no ids, hashes of no bytes); a null doc_id stays null;
    repeated rows each get their row; further columns of docs are ignored; texts of
    any length are read whole; no rows give no rows.
    """
    path = vocabulary or vocabulary_path("byte_bpe_50k.tiktoken")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_encode(path, with_ids), schema)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = [None if ids is None else bpe.decode(np.array(ids, "<u4").tobytes()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    return run


def bpe_decode(tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, bytes: the bytes of each row's ids (null ids give null)."""
    path = vocabulary or vocabulary_path("byte_bpe_50k.tiktoken")
    return tokens.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, bytes binary")
