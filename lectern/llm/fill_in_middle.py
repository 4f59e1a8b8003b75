"""Fill-in-middle rows by one numpy kernel over the UTF-8 buffer of a whole batch.

A byte-class lookup marks white space, a mask over adjacent bytes marks where
tokens begin, and cumulative sums less each document's own start number them; one
binary search over those sums finds the cuts of all rows together, and one gather
writes all rows' outputs.  No row is handled by itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import pieces
from .words import SPACES

# The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return bytes_, offsets - offsets[0]


def strings(data: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A column of strings over those bytes; not valid rows are null."""
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes()), mask)


def _sums(flags: np.ndarray) -> np.ndarray:
    """How many flags stand before each position, and at the end."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _found(data: np.ndarray, offsets: np.ndarray, mark: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(position, row) of every occurrence of a mark that lies in one row."""
    if len(data) < len(mark):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    last = len(data) - len(mark) + 1
    at = np.flatnonzero(data[:last] == mark[0])
    for k in range(1, len(mark)):
        at = at[data[at + k] == mark[k]]
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at + len(mark) <= offsets[row + 1]
    return at[inside], row[inside]


def _gather(source: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of rows that are put together from segments (rows x segments) of the source."""
    flat = size.ravel()
    ends = np.cumsum(flat)
    index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start.ravel() - (ends - flat), flat)
    return source[index], np.concatenate([[0], np.cumsum(size.sum(axis=1))]).astype(np.int64)


def transform(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray, rate: int, spm_share: int, marks: Sequence[str]) -> dict[str, np.ndarray]:
    """n, form (0 plain, 1 psm, 2 spm), prefix_chars, middle_chars, and the outputs' bytes and offsets of all rows."""
    lo, hi = offsets[:-1], offsets[1:]
    space = _SPACE[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = space[1:] & ~space[:-1]
    begins[lo[lo < hi]] = True
    before = _sums(begins)
    n = before[hi] - before[lo]
    units = np.sort(draws[:, :2] % (n[:, None] + 1), axis=1)
    # The start of the token behind a cut; behind a row's last token that is where the next row begins.
    cuts = np.searchsorted(before[1:], before[lo][:, None] + units + 1)
    marked = np.zeros(len(n), bool)
    for mark in marks:
        marked[_found(data, offsets, mark.encode())[1]] = True
    plain = (lo == hi) | marked | (draws[:, 2] % 100 >= rate)
    spm = ~plain & (draws[:, 3] % 100 < spm_share)
    chars = _sums((data & 0xC0) != 0x80)
    first, second = np.minimum(cuts[:, 0], hi), np.minimum(cuts[:, 1], hi)
    # Segments of an output: mark, text, mark, text, mark, text; a plain one is its text alone.
    p, s, m = (len(data) + np.array([0, *np.cumsum([len(x.encode()) for x in marks])[:-1]])).tolist()
    size_p, size_s, size_m = (len(x.encode()) for x in marks)
    full, none = np.ones(len(n), np.int64), np.zeros(len(n), np.int64)
    prefix, suffix, middle = (lo, first - lo), (second, hi - second), (first, second - first)
    psm_start = np.stack([full * p, prefix[0], full * s, suffix[0], full * m, middle[0]], axis=1)
    psm_size = np.stack([full * size_p, prefix[1], full * size_s, suffix[1], full * size_m, middle[1]], axis=1)
    swap = [2, 3, 0, 1, 4, 5]
    start, size = np.where(spm[:, None], psm_start[:, swap], psm_start), np.where(spm[:, None], psm_size[:, swap], psm_size)
    start[plain, 0] = lo[plain]
    size[plain] = np.stack([hi - lo, none, none, none, none, none], axis=1)[plain]
    out, out_offsets = _gather(np.concatenate([data, np.frombuffer("".join(marks).encode(), np.uint8)]), start, size)
    return {
        "n": n, "plain": plain, "form": np.where(plain, 0, np.where(spm, 2, 1)), "prefix_chars": chars[first] - chars[lo], "middle_chars": chars[second] - chars[first], "output": out, "offsets": out_offsets,
    }


def rebuild(data: np.ndarray, offsets: np.ndarray, form: np.ndarray, marks: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of the texts that outputs were made from: valid where each mark stands once and in the form's order."""
    lo, hi = offsets[:-1], offsets[1:]
    at, times = np.zeros((3, len(form)), np.int64), np.zeros((3, len(form)), np.int64)
    for k, mark in enumerate(marks):
        where, row = _found(data, offsets, mark.encode())
        at[k, row] = where
        times[k] = np.bincount(row, minlength=len(form))
    size = np.array([len(x.encode()) for x in marks])[:, None]
    text = at + size  # where each part begins
    psm, spm = form == 1, form == 2
    ends = np.stack([np.where(psm, at[1], at[2]), np.where(psm, at[2], at[0]), hi])
    whole = (times == 1).all(axis=0) & (at[0] * psm + at[1] * spm == lo * (psm | spm)) & (text <= ends).all(axis=0)
    valid = (form == 0) | whole
    start, length = text[[0, 2, 1]].T.copy(), (ends - text)[[0, 2, 1]].T.copy()
    start[form == 0, 0] = lo[form == 0]
    length[form == 0] = 0
    length[form == 0, 0] = (hi - lo)[form == 0]
    length[~valid] = 0
    return (*_gather(data, start, length), valid)


_FORMS = pa.array(["plain", "psm", "spm"])


def _transform(rate: int, spm_share: int, marks: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            draws = np.stack([batch.column(f"h{k}").to_numpy(zero_copy_only=False) for k in range(1, 5)], axis=1)
            made = transform(*utf8(batch.column("text")), draws, rate, spm_share, marks)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(made["n"], pa.int64()), _FORMS.take(pa.array(made["form"])),
                    *(pa.array(made[c], pa.int64(), mask=made["plain"]) for c in ("prefix_chars", "middle_chars")), strings(made["output"], made["offsets"]),
                ],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_share: int = 80, marks: tuple[str, ...] = MARKS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row per input row.

    A text is cut into n tokens, each a run of other characters with the white
    space (blank, U+0009 to U+000D) before it, or the white space at the text's end.  Four
    numbers come from the sha256 of ``seed:doc_id``: the first two, modulo n + 1,
    are the tokens before the middle and before the suffix; a text stays plain if
    the third modulo 100 is ``rate`` or more, and is in suffix-first form if
    the fourth modulo 100 is under ``spm_share``.  Empty texts and texts that hold
    a mark stay plain, and prefix_chars and middle_chars are null then.

    Null text counts as empty; a null doc_id draws as if it were written as
    nothing; repeated rows each get their row; texts of any length are taken
    whole; further columns of docs are ignored; no rows give no rows.  One map
    stage, nothing is shuffled.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *draws)
    return rows.mapInArrow(_transform(rate, spm_share, tuple(marks)), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _restore(marks: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            form = pc.fill_null(pc.index_in(batch.column("form"), value_set=_FORMS), 3).to_numpy(zero_copy_only=False)
            data, offsets, valid = rebuild(*utf8(batch.column("output")), form, marks)
            known = valid & batch.column("output").is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns)), strings(data, offsets, known)], [*batch.schema.names, "restored"])

    return run


def restore(rows: DataFrame, marks: tuple[str, ...] = MARKS) -> DataFrame:
    """rows (with form and output) and ``restored``, the exact text that each output was made from.

    Null where form or output is null or unknown, or the output does not hold each
    mark once in the order of its form.  Other columns stay; repeated rows stay; no
    rows give no rows.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "restored")
    return rows.drop("restored").mapInArrow(_restore(tuple(marks)), f"{kinds}, restored string")
