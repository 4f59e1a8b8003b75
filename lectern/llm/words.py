"""Vectorised word and shingle hashing shared by the near-copy operators.

Words are maximal runs of bytes outside a separator set.  With the default set
(``\\x20 \\x09-\\x0D``) this is the same split on UTF-8 bytes as on characters,
and the lower-casing table touches A-Z alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)
SPACES = bytes([0x20, *range(0x09, 0x0E)])
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, elementwise."""
    x = (x ^ (x >> _SHIFT)) * _M1
    x = (x ^ (x >> _SHIFT)) * _M2
    return x ^ (x >> _SHIFT)


def multipliers(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHasher:
    """Word boundaries and 64-bit word hashes of whole buffers.

    A word's hash is its polynomial over a fixed random byte table, read as a
    difference of prefix sums, so the work is a few array passes and no Python
    per word.  A single word longer than a chunk is hashed with longer tables.
    """

    def __init__(self, lower: bool = False, separators: bytes = SPACES):
        self.is_sep = np.zeros(256, bool)
        self.is_sep[list(separators)] = True
        table = np.random.default_rng(40_013).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if lower:
            table[65:91] = table[97:123]
        self.table = table
        self._powers(CHUNK)

    def _powers(self, n: int) -> None:
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)
        self.power = np.cumprod(np.full(n + 1, base, np.uint64))
        self.inverse = np.cumprod(np.full(n + 1, inverse, np.uint64))

    def _piece(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(buf) > len(self.power) - 1:
            self._powers(len(buf))
        word = np.empty(len(buf) + 2, np.int8)
        word[0] = word[-1] = 0
        word[1:-1] = ~self.is_sep[buf]
        word &= 1
        step = np.diff(word)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.table[buf] * self.power[: len(buf)], out=sums[1:])
        return starts, ends, mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, hashes) of the words of a buffer."""
        buf = np.frombuffer(data, np.uint8)
        if len(buf) <= CHUNK:
            return self._piece(buf)
        parts, at = [], 0
        while at < len(buf):
            to = min(len(buf), at + CHUNK)
            if to < len(buf):
                cut = np.flatnonzero(self.is_sep[buf[at:to]])
                if len(cut):
                    to = at + int(cut[-1]) + 1
                else:
                    later = np.flatnonzero(self.is_sep[buf[to:]])
                    to = to + int(later[0]) + 1 if len(later) else len(buf)
            s, e, h = self._piece(buf[at:to])
            parts.append((s + at, e + at, h))
            at = to
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]

    def documents(self, texts: list[bytes | None]) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Batches of about a chunk: (from, to, buffer, starts, ends, hashes, first word of each document and the end)."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or b"") < CHUNK):
                size += len(texts[to] or b"") + 1
                to += 1
            data = b"\n".join([t or b"" for t in texts[at:to]])
            starts, ends, hashes = self(data)
            edge = np.cumsum([0] + [len(t or b"") + 1 for t in texts[at:to]])
            yield at, to, data, starts, ends, hashes, np.searchsorted(starts, edge)
            at = to


def gram_hashes(words: np.ndarray, n: int, seed: int = 20_011) -> np.ndarray:
    """Hash of every run of n consecutive word hashes (empty with fewer words)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    odd = multipliers(n, seed)
    out = words[:m] * odd[0]
    for j in range(1, n):
        out += words[j : j + m] * odd[j]
    return mix(out)


def shingle_set(words: np.ndarray, grams: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of one document; a shorter sequence counts as one shingle.

    grams: the n-gram hashes that start at each of its words, those that would
    run past the document's end included (they are cut off here).
    """
    if len(words) == 0:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return gram_hashes(words, len(words), seed=30_000 + len(words))
    return np.unique(grams[: len(words) - n + 1])
