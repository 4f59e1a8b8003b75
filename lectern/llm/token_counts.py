"""Token counts from a two-tier pre-token lookup that never shuffles pre-tokens.

First tier: a compact hash table (64-bit hash, one-byte length) of the corpus's
frequent pre-tokens, broadcast once; its size is fixed.  Second tier: a
worker's bounded memo, filled by the tokenizer library itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut
from .tokenizer_files import vocabulary_path

#: Entries of the first tier (9 bytes each) and of each partial summary.
FREQUENT = 65_536
SUMMARY = 16_384
FAN_IN = 32
MEMO_LIMIT = 400_000
#: Characters of a pre-token past which it is in neither tier's memory but goes to the library each time.
LONG = 256
_RUNS = re.compile(" *[^ ]+| +")


class PieceCounter:
    """Token counts of independent pieces of a text.

    No piece of the vocabulary goes on past its own leading blanks, so a text
    falls apart before each run of blanks; if none holds a line feed either, it
    also falls apart around each line feed.  Both are checked on the model.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.blank = "▁"
        if any(self.blank in p.lstrip(self.blank) for p in pieces):
            raise ValueError("the vocabulary has pieces that cross a blank")
        self.lines = not any("\n" in p for p in pieces)
        self.feed = self._count(["\n"])[0] - 1 if self.lines else 0
        self.memo: dict[str, int] = {}

    def _count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)] if texts else []

    def split(self, text: str) -> list[str]:
        """Pre-tokens; each but those after a line feed stands for itself with one blank before it."""
        if self.blank in text:
            text = text.replace(self.blank, " ")
        parts = _RUNS.findall(" " + text) if "  " in text or text[:1] == " " or text[-1:] == " " else [" " + p for p in text.split(" ")]
        if not self.lines or "\n" not in text:
            return parts
        out: list[str] = []
        for p in parts:
            if "\n" in p:
                pieces = p.split("\n")
                out.append(pieces[0])
                for q in pieces[1:]:
                    out.append("\n")
                    if q:
                        out.append("\n" + q)
            else:
                out.append(p)
        return out

    def lengths(self, words: list[str]) -> list[int]:
        """Tokens of each pre-token, from the library."""
        plain = [w for w in words if w[0] == " "]
        after = [w for w in words if w[0] != " " and w != "\n"]
        known = dict(zip(plain, self._count([w[1:] for w in plain]), strict=True))
        # After a line feed there is no blank: count with the feed, less the blank and the feed.
        known.update(zip(after, (n - 1 - self.feed for n in self._count(after)), strict=True))
        known["\n"] = self.feed
        known[" "] = 1  # the library gives no token for an empty text, but one for a blank inside
        return [known[w] for w in words]


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def _hash(words: list[str]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)


def _trim(counts: Counter, size: int) -> Counter:
    """Misra-Gries: no word of more than total / size occurrences is lost."""
    if len(counts) <= size:
        return counts
    floor = sorted(counts.values(), reverse=True)[size]
    return Counter({w: n - floor for w, n in counts.items() if n > floor})


def _pack(counts: Counter) -> tuple[list[str], list[int]]:
    """The words of bounded length and their counts."""
    short = {w: n for w, n in counts.items() if len(w) <= LONG}
    return list(short), list(short.values())


def _summarise(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = counter(path).split, Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    counts.update(split(text))
                    if len(counts) > 20 * SUMMARY:
                        counts = _trim(counts, 10 * SUMMARY)
        words, sizes = _pack(_trim(counts, SUMMARY))
        yield pa.RecordBatch.from_arrays([pa.array([words], pa.list_(pa.string())), pa.array([sizes], pa.list_(pa.int64()))], ["words", "counts"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for words, sizes in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            for w, n in zip(words, sizes, strict=True):
                counts[w] += n
            counts = _trim(counts, 4 * SUMMARY)
    words, sizes = _pack(_trim(counts, 4 * SUMMARY))
    yield pa.RecordBatch.from_arrays([pa.array([words], pa.list_(pa.string())), pa.array([sizes], pa.list_(pa.int64()))], ["words", "counts"])


def frequent_pre_tokens(docs: DataFrame, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and token lengths of the corpus's most frequent pre-tokens.

    Every partition summarises all its texts in a Misra-Gries counter of fixed
    size; only those summaries move, up a tree of bounded fan-in.  Words past LONG
    characters are left out, so the bytes that move are bounded too.
    """
    schema = "words array<string>, counts array<long>"
    summaries = cut(docs.select("text").mapInArrow(_summarise(vocabulary), schema))
    parts = summaries.rdd.getNumPartitions()
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        summaries = cut(summaries.repartition(parts).mapInArrow(_merge, schema))
    counts: Counter = Counter()
    for row in summaries.coalesce(1).mapInArrow(_merge, schema).collect():
        counts.update(dict(zip(row.words, row.counts, strict=True)))
    words = [w for w, _ in counts.most_common(FREQUENT)]
    sizes = np.array(counter(vocabulary).lengths(words) if words else [], np.int64)
    hashes = _hash(words)
    # One byte a length; two words of one hash would be ambiguous: neither is kept.
    hashes, first, times = np.unique(hashes, return_index=True, return_counts=True)
    keep = (times == 1) & (sizes[first] < 256)
    return hashes[keep], sizes[first][keep].astype(np.uint8)


def _count(path: str, table, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(path)
        memo = pieces.memo
        hashes, sizes = table.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n_bytes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            n_tokens = []
            for text in texts:
                words = pieces.split(text) if text else []
                try:
                    n_tokens.append(sum(map(memo.__getitem__, words)))
                    continue
                except KeyError:
                    missing = list(set(words).difference(memo))
                found = _hash(missing)
                at = np.minimum(np.searchsorted(hashes, found), max(0, len(hashes) - 1))
                hit = hashes[at] == found if len(hashes) else np.zeros(len(found), bool)
                memo.update((missing[i], int(sizes[at[i]])) for i in np.flatnonzero(hit).tolist())
                rest = [missing[i] for i in np.flatnonzero(~hit).tolist()]
                memo.update(zip(rest, pieces.lengths(rest), strict=True))
                n_tokens.append(sum(map(memo.__getitem__, words)))
                full = len(memo) > MEMO_LIMIT  # what came first stays
                for w in rest:
                    if full or len(w) > LONG:
                        del memo[w]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per input row.

    Tokens of every whole text as the vocabulary's library gives them, without
    begin or end tokens; over_limit is n_tokens > limit.  Null and empty texts
    have no bytes and no tokens; a null doc_id stays null; repeated rows each get
    their row; further columns of docs are ignored; no rows give no rows.
    """
    path = vocabulary or vocabulary_path("piece_bpe_32k.model")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(frequent_pre_tokens(texts, path))
    return texts.mapInArrow(_count(path, table, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
