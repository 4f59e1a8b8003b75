"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

The distinct words of a batch lie one behind another in flat symbol arrays.  Each
round finds every segment's minimum pair rank by one segmented reduction, merges
the leftmost such pair of each segment (all of them from left to right, where the
merged piece can start nothing sooner), closes the gaps, and drops the segments
that have no pair left.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import NONE, PairTable
from .session import pieces
from .tokenizer_files import vocabulary_path

BLANK = "▁"
MEMO_LIMIT = 250_000
#: Characters of a word past which it is encoded each time and never kept.
LONG = 256
#: Rounds after which what is still unmerged (a long run of one unsafe piece) takes a heap, which merges the same pairs in n log n.
ROUNDS = 64
_RUNS = re.compile(" *[^ ]+| +")

codecs.register_error("lectern-bytewise", lambda e: ("�", e.start + 1))


def _flags(n: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[at] = True
    return out


class PieceBpe:
    """Encoder and decoder over a model file.

    Words of a text are its runs of blanks with what follows them, one blank put
    before the text.  Between two characters that stand side by side in no piece
    nothing ever merges, so a word falls apart there into segments.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, kinds = model.normalizer_spec, model.SentencePiece
        plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix or not plain:
            raise ValueError("only BPE models with byte fallback and no normalisation are read")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not read")
        names = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if any(BLANK in p.lstrip(BLANK) for p in names):
            raise ValueError("the vocabulary has pieces that cross a blank")
        self.size = len(model.pieces)
        self.byte_id = np.zeros(256, np.int64)
        self.bytes_of = [b""] * self.size
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[3:-1], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif p.type == kinds.UNKNOWN:
                self.bytes_of[i] = model.trainer_spec.unk_surface.encode()
            elif p.type == kinds.NORMAL:
                self.bytes_of[i] = p.piece.replace(BLANK, " ").encode()
        self.leads = {i for p, i in names.items() if p.startswith(BLANK)}
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        # Symbols: piece ids; beyond them characters that only longer pieces hold; -1 - code point for all other characters.
        rest = sorted({c for p in names for c in p} - set(names))
        self.rest = np.array([ord(c) for c in rest], np.int64)
        symbol = dict(names) | {c: self.size + k for k, c in enumerate(rest)}
        self.symbol = -1 - np.arange(0x110000)
        for c, i in symbol.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        scores = [model.pieces[i].score for i in names.values()]
        place = {s: k for k, s in enumerate(sorted(set(scores), reverse=True))}
        rank = {i: place[s] for i, s in zip(names.values(), scores, strict=True)}
        self.bits = self.size.bit_length()
        left, right, made = [], [], []
        for p, i in names.items():
            for cut in range(1, len(p)):
                a, b = symbol.get(p[:cut]), symbol.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(i)
        value = [rank[i] << self.bits | i for i in made]
        self.pairs = PairTable(*(np.array(x, np.int64) for x in (left, right, value)))
        self.pair_value = dict(zip(zip(left, right, strict=True), value, strict=True))
        # A piece is safe if every pair that it is part of ranks behind it: what it makes then cannot come before the other pairs of its rank.
        self.safe = np.ones(self.size + len(rest), bool)
        for a, b, i in zip(left, right, made, strict=True):
            for part in (a, b):
                if part in rank and rank[i] <= rank[part]:
                    self.safe[part] = False
        beside = sorted({(ord(a), ord(b)) for p in names for a, b in zip(p, p[1:], strict=False)})
        self.beside = PairTable(*(np.array(x, np.int64) for x in ([a for a, _ in beside], [b for _, b in beside], [1] * len(beside))))
        self.memo: dict[str, bytes] = {}

    def _pairs(self, sym: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Values of the pairs that begin at those places (NONE at a segment's end)."""
        out = np.full(len(at), NONE)
        inner = np.flatnonzero(at + 1 < len(sym))
        inner = inner[owner[at[inner]] == owner[at[inner] + 1]]
        out[inner] = self.pairs(sym[at[inner]], sym[at[inner] + 1])
        return out

    def _rounds(self, sym: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, symbols) after all merges; owner numbers the segments, in order."""
        place, value = np.arange(len(sym)), self._pairs(sym, owner, np.arange(len(sym)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for turn in range(ROUNDS + 1):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            size = np.diff(starts, append=len(sym))
            low = np.minimum.reduceat(value, starts) if len(starts) else np.empty(0, np.int64)
            live = np.repeat(low < NONE, size)
            if not live.all():
                done.append((place[~live], sym[~live]))
                place, sym, owner, value = place[live], sym[live], owner[live], value[live]
                size, low = size[low < NONE], low[low < NONE]
            if not len(sym):
                break
            if turn == ROUNDS:
                done.append(self._by_heap(place, sym, owner))
                break
            at = np.flatnonzero(value >> self.bits == np.repeat(low >> self.bits, size))
            mine = owner[at]
            first = np.diff(mine, prepend=-1) != 0
            merged = value[at] & ((1 << self.bits) - 1)
            # Of pairs that overlap in a run, every other one from the left is merged.
            breaks = first | (np.diff(at, prepend=-2) != 1)
            step = np.arange(len(at)) - np.maximum.accumulate(np.where(breaks, np.arange(len(at)), 0))
            group = np.cumsum(first) - 1
            calm = np.bincount(group, weights=~self.safe[merged]) == 0
            take = np.where(calm[group], step % 2 == 0, first)
            at, merged = at[take], merged[take]
            sym[at] = merged
            keep = ~_flags(len(sym), at + 1)
            at = np.cumsum(keep)[at] - 1
            place, sym, owner, value = place[keep], sym[keep], owner[keep], value[keep]
            value[at] = self._pairs(sym, owner, at)
            at = at[at > 0] - 1
            value[at] = self._pairs(sym, owner, at)
        places = np.concatenate([p for p, _ in done])
        order = np.argsort(places)
        return places[order], np.concatenate([s for _, s in done])[order]

    def _by_heap(self, place: np.ndarray, sym: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same merges for what the rounds have left: best rank first, leftmost of those."""
        ids, mine, pairs = sym.tolist(), owner.tolist(), self.pair_value
        n, mask = len(ids), (1 << self.bits) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and mine[i] == mine[j] and (v := pairs.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (v >> self.bits, i, ids[i], ids[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = pairs[a, b] & mask, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        left = [i for i in range(n) if ids[i] is not None]
        return place[left], np.array([ids[i] for i in left], np.int64)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        edges = np.cumsum([0, *map(len, words)])
        cut = np.ones(len(code), bool)
        cut[1:] = self.beside(code[:-1], code[1:]) >= NONE
        cut[edges[:-1][np.diff(edges) > 0]] = True
        places, sym = self._rounds(self.symbol[code], np.cumsum(cut) - 1)
        # Characters of no piece become their bytes.
        odd = np.flatnonzero((sym < 0) | (sym >= self.size))
        points = np.where(sym[odd] < 0, -1 - sym[odd], self.rest[np.clip(sym[odd] - self.size, 0, max(0, len(self.rest) - 1))] if len(self.rest) else 0)
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in points.tolist()]
        times = np.ones(len(sym), np.int64)
        times[odd] = [len(b) for b in raw]
        ids = np.repeat(sym, times)
        ids[_flags(len(sym), odd).repeat(times)] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.concatenate([[0], np.cumsum(times)])[np.searchsorted(places, edges)]
        packed = ids.astype("<u4").tobytes()
        return [packed[4 * a : 4 * b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]

    @staticmethod
    def split(text: str) -> list[str]:
        """A text's words, each less the blank before it."""
        if BLANK in text:
            text = text.replace(BLANK, " ")
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [w[1:] for w in _RUNS.findall(" " + text)]
        return text.split(" ") if text else []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, packed likewise."""
        memo = self.memo
        split = [self.split(t) for t in texts]
        missing = list(set().union(*split).difference(memo))
        memo.update(zip(missing, self.encode_words([BLANK + w.replace(" ", BLANK) for w in missing]), strict=True))
        out = [b"".join(map(memo.__getitem__, words)) for words in split]
        full = len(memo) > MEMO_LIMIT  # what came first, the frequent words among it, stays
        for w in missing:
            if full or len(w) > LONG:
                del memo[w]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of packed ids: the blank that opens it goes, bytes that make no character are replaced one by one."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        raw = b"".join(map(self.bytes_of.__getitem__, numbers))
        opening = next((i for i in numbers if i not in self.silent), None)
        return (raw[1:] if opening in self.leads else raw).decode("utf-8", "lectern-bytewise")


@lru_cache(maxsize=2)
def codec(path: str) -> PieceBpe:
    """One codec for each worker process and model."""
    return PieceBpe(path)


def _encode(path: str, with_decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in pieces(batches):
            ids = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
            edges = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            columns = [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(ids), "<i4")))]
            if with_decoded:
                columns.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    return run


def piece_encode(docs: DataFrame, model: str | None = None, with_decoded: bool = False) -> DataFrame:
    """doc_id, ids (and decoded, the text of those ids, on request): one row per input row.

    The ids of every whole text by ``model`` (a model file's path), without begin
    or end ids and without sampling.  Null text counts as empty (no ids, an empty
    text back); a null doc_id stays null; repeated rows each get their row; texts
    of any length are taken whole; further columns of docs are ignored; no rows
    give no rows.  One map stage, nothing is shuffled.
    """
    path = model or vocabulary_path("piece_bpe_32k.model")
    schema = "doc_id long, ids array<int>" + (", decoded string" if with_decoded else "")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_encode(path, with_decoded), schema)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in pieces(batches):
            texts = [None if ids is None else bpe.decode(np.array(ids, "<u4").tobytes()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def piece_decode(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text: the text of each row's ids (null ids give null); repeated rows stay, no rows give no rows."""
    path = model or vocabulary_path("piece_bpe_32k.model")
    return tokens.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, text string")
