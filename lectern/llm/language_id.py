"""Language identification by cross-parsing entropy.

Each language keeps a suffix automaton of labelled text.  A text is parsed into
phrases, each the longest prefix of what is left that occurs in that language's
text; the language whose parse has the fewest phrases, each weighed by the bits
of a position in its text, wins.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import held_out, labelled_sample
from .session import pieces

#: Characters of labelled text kept for each language, of one labelled document, and of all languages together.
TRAIN_CHARS = 24_000
TRAIN_DOC_CHARS = 6_000
TRAIN_DOCS = 64
MODEL_CHARS = 12_000_000
#: Cells of all transition tables that are kept dense; a language past its share has a sorted list of its transitions.
DENSE_CELLS = 24_000_000
#: A text is parsed in stretches of this many characters, all side by side.
STRETCH = 256
LANES = 2048
#: Characters of texts that are parsed together (a longer text goes alone).
TOGETHER = 500_000


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters (ASCII by range, others by their property)."""
    return _letter_table()[np.minimum(codes, 0x10FFFF)]


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


class SuffixAutomaton:
    """Transitions of the suffix automaton of a sequence of small symbols."""

    def __init__(self, symbols: list[int], size: int, dense: bool = True):
        longest, link, step = [0], [-1], [{}]
        last = 0
        for c in symbols:
            now = len(longest)
            longest.append(longest[last] + 1)
            link.append(0)
            step.append({})
            p = last
            while p != -1 and c not in step[p]:
                step[p][c] = now
                p = link[p]
            if p != -1:
                q = step[p][c]
                if longest[p] + 1 == longest[q]:
                    link[now] = q
                else:
                    copy = len(longest)
                    longest.append(longest[p] + 1)
                    link.append(link[q])
                    step.append(dict(step[q]))
                    while p != -1 and step[p].get(c) == q:
                        step[p][c] = copy
                        p = link[p]
                    link[q] = link[now] = copy
            last = now
        self.size = size
        count = sum(map(len, step))
        keys = np.fromiter((state * size + c for state, edges in enumerate(step) for c in edges), np.int64, count)
        to = np.fromiter((t for edges in step for t in edges.values()), np.int32, count)
        self.table = np.full(len(step) * size, -1, np.int32) if dense else None
        if dense:
            self.table[keys] = to
        else:
            order = np.argsort(keys)
            self.keys, self.to = keys[order], to[order]

    def follow(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next state of each lane, -1 where there is none."""
        key = state * np.int64(self.size) + symbol
        if self.table is not None:
            return self.table[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)


class Parser:
    """All languages' automata, each over the letters of its own text."""

    def __init__(self, model: tuple[tuple[str, str], ...]):
        self.languages = [name for name, _ in model]
        texts = [_codes(text) for _, text in model]
        every = np.concatenate(texts) if texts else np.empty(0, np.uint32)
        kept = np.unique(every[letters(every)])
        # 0: anything but a letter (runs of it are one symbol); 1: a letter of no language's text.
        self.symbol = np.zeros(0x110000, np.int32)
        self.symbol[_letter_table()] = 1
        self.symbol[kept] = np.arange(2, 2 + len(kept))
        self.bits, self.automata, self.own = [], [], []
        share = DENSE_CELLS // max(1, len(texts))
        for codes in texts:
            symbols = self.symbols(codes)
            used = np.unique(symbols)
            own = np.zeros(2 + len(kept), np.int32)  # 0: a symbol that this text lacks
            own[used] = np.arange(1, 1 + len(used))
            self.own.append(own)
            self.automata.append(SuffixAutomaton(own[symbols].tolist(), 1 + len(used), 2 * len(symbols) * (1 + len(used)) <= share))
            self.bits.append(np.log2(max(2, len(symbols))))

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        s = self.symbol[np.minimum(codes, 0x10FFFF)]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        return s[keep]

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Bits per symbol of each text under each language (infinite without letters)."""
        parts, owner = [], []
        lengths = np.zeros(len(texts))
        for i, text in enumerate(texts):
            s = self.symbols(_codes(text)) if text else np.empty(0, np.int32)
            if not (s > 0).any():
                continue
            lengths[i] = len(s)
            n = -(-len(s) // STRETCH)
            block = np.full(n * STRETCH, -1, np.int32)
            block[: len(s)] = s
            parts.append(block.reshape(n, STRETCH))
            owner.append(np.full(n, i))
        out = np.full((len(texts), len(self.languages)), np.inf)
        if not parts or not self.languages:
            return out
        grid, owners = np.concatenate(parts), np.concatenate(owner)
        phrases = np.stack([self._phrases(grid, automaton, own) for automaton, own in zip(self.automata, self.own, strict=True)], axis=1)
        total = np.zeros((len(texts), len(self.languages)))
        np.add.at(total, owners, phrases)
        some = lengths > 0
        out[some] = total[some] * np.array(self.bits) / lengths[some, None]
        return out

    @staticmethod
    def _phrases(grid: np.ndarray, automaton: SuffixAutomaton, own: np.ndarray) -> np.ndarray:
        """Phrases of each stretch, one step of every lane at a time; a symbol that the language lacks is a phrase of its own."""
        count = np.empty(len(grid), np.int64)
        for at in range(0, len(grid), LANES):
            columns = np.ascontiguousarray(grid[at : at + LANES].T)
            lanes = columns.shape[1]
            state, phrases = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
            full = (columns[-1] >= 0).all()
            for symbols in columns:
                if full:
                    mine = own[symbols]
                else:
                    live = symbols >= 0
                    mine = own[np.where(live, symbols, 0)]
                to = automaton.follow(state, mine)
                begins = (to < 0) | (state == 0)
                if not full:
                    begins &= live
                    to = np.where(live, to, state)
                phrases += begins
                stuck = np.flatnonzero(to < 0)
                if len(stuck):
                    to[stuck] = np.maximum(automaton.follow(np.zeros(len(stuck), np.int32), mine[stuck]), 0)
                state = to
            count[at : at + LANES] = phrases
        return count


@lru_cache(maxsize=1)
def parser(model: tuple[tuple[str, str], ...]) -> Parser:
    """Built once in each worker process from the broadcast texts."""
    return Parser(model)


def train(docs: DataFrame, learn: Column) -> tuple[tuple[str, str], ...]:
    """(language, text) for every labelled language: at most TRAIN_CHARS characters each, and MODEL_CHARS together."""
    sample = labelled_sample(docs.filter(learn & F.col("text").rlike(r"\p{L}")), "lang", TRAIN_DOCS, TRAIN_DOC_CHARS)[0]
    most = min(TRAIN_CHARS, MODEL_CHARS // max(1, len(sample)))
    model = []
    for name, rows in sample.items():
        kept, size = [], 0
        for _, text in rows:
            if size < most:
                kept.append(text[: most - size])
                size += len(kept[-1])
        model.append((name, "\n".join(kept)))
    return tuple(model)


def _predictions(p: Parser, texts: list[str | None]) -> Iterator[tuple[int, int, list[str], list[float], list[float | None]]]:
    """(from, to, languages, scores, bits per symbol) for texts in runs of bounded size."""
    row = 0
    while row < len(texts):
        to, size = row, 0
        while to < len(texts) and (to == row or size < TOGETHER):
            size += len(texts[to] or "")
            to += 1
        pred, score, cost = [], [], []
        for line in p.entropies([t or "" for t in texts[row:to]]):
            order = np.argsort(line, kind="stable")
            if not len(line) or not np.isfinite(line[order[0]]):
                pred.append("und")
                score.append(0.0)
                cost.append(None)
                continue
            best = float(line[order[0]])
            second = float(line[order[1]]) if len(line) > 1 else 2 * best
            pred.append(p.languages[order[0]])
            score.append(second / (best + second) * 2 - 1 if second > 0 else 0.0)
            cost.append(best)
        yield row, to, pred, score, cost
        row = to


def _identify(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(model.value)
        for batch in pieces(batches):
            for row, to, pred, score, cost in _predictions(p, batch.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, to - row), batch.column("held_out").slice(row, to - row), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(cost, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score", "bits_per_char"],
                )

    return run


def identify_language(docs: DataFrame, modulus: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_char: one row per input row.

    Learns from text and non-null lang of rows outside the held-out fold (crc32 of
    doc_id as text, modulo ``modulus``, equal to ``fold``; a null doc_id counts as
    neither).  Every labelled language has a model, however many there are and
    whatever letters it is written in: TRAIN_DOCS of its documents, TRAIN_DOC_CHARS
    of each (a passage of a longer one), TRAIN_CHARS in all, or less where
    MODEL_CHARS does not go round.  Prediction reads the whole text and nothing
    else, in stretches of STRETCH symbols, at whose ends a phrase ends too.  A null
    text or one without a letter is ``und`` with score 0, and so is everything when
    nothing is labelled.  score is the relative gap between the best and the second
    language, 0 to 1.  Ties go to the language that sorts first.  Repeated rows each
    get their row; further columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    out = held_out(F.col("doc_id"), modulus, fold)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang"), out.alias("held_out"))
    model = train(rows, ~F.col("held_out") & F.col("doc_id").isNotNull())
    shared = spark.sparkContext.broadcast(model)
    return rows.select("doc_id", "text", "held_out").mapInArrow(_identify(shared), "doc_id long, held_out boolean, lang_pred string, score double, bits_per_char double")


def _keep(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(model.value)
        for batch in pieces(batches):
            at = batch.schema.get_field_index("lang")
            for row, to, pred, _score, _cost in _predictions(p, batch.column("text").to_pylist()):
                lang = pa.array(pred, batch.schema.field(at).type)
                told = pa.array([name != "und" for name in pred])
                yield batch.slice(row, to - row).set_column(at, batch.schema.field(at), lang).filter(told)

    return run


def keep_identified(docs: DataFrame, modulus: int = 3, fold: int = 1) -> DataFrame:
    """The rows of docs whose language identify_language names, lang set to that name; ``und`` rows go.

    All other columns stay as they are, repeated rows and null ids included (a
    null id's text is no example, but is told like any other).  Where no row is
    labelled there is nothing to tell languages by: a warning is issued and the rows
    with a letter stay with a null lang as before.  No rows give no rows; nothing is
    shuffled.
    """
    model = train(docs.select("doc_id", "text", "lang"), ~held_out(F.col("doc_id"), modulus, fold) & F.col("doc_id").isNotNull())
    if not model:
        warnings.warn("no labelled text to learn a language from: rows with a letter stay unidentified", stacklevel=2)
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return docs.mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(model)), docs.schema)
