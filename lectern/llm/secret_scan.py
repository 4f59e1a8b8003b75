"""Secret scanning with structural confirmation.

Three base patterns are reported as they match.  Base64 and hex candidates are
decoded, and reported as keys or tokens only if their bytes parse: DER key
encodings with consistent nested lengths, length-prefixed SSH keys, and signed
tokens whose header is JSON with an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import pieces

# The kinds, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "der_key", "ssh_key", "signed_token")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A break inside an armoured key: a line end, real or escaped as in JSON, with an indent and the marks of comments and
#: quotations behind it; literals of source code may end before it and open again behind it, also on one line.
_SPACE = r"[\x20\t]*"
_ESCAPED = r"(?:\\+r)?\\+n"
_END = rf"""(?:(?:{_ESCAPED})?(?:["']{_SPACE}[+.,\\]?|{_SPACE}\\(?![rn]))?{_SPACE}(?:\r\n?|\n)|{_ESCAPED})"""
FOLD = rf"""(?:{_END}{_SPACE}(?:(?:[>\#*;]+|//+(?=[\x20\t])|--+(?=[\x20\t])){_SPACE})*(?:[+.]{_SPACE}(?=["']))?["']?|["']{_SPACE}[+.]{_SPACE}["'])"""
#: Candidates of the method: a line of letters and further ones, the last of which may be a single quantum.
BASE64 = re.compile(rf"[A-Za-z0-9+/]{{40,}}(?:{FOLD}[A-Za-z0-9+/]+)*={{0,2}}")
FOLDS = re.compile(FOLD)
#: Behind letters of a path a key may open too: a long DER sequence or an SSH head.
INNER = re.compile(r"(?<=[+/])(?=MI[A-Za-z0-9+/]|AAAA|b3BlbnNzaC1rZXk)")
KEY_NAME = re.compile(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+")
#: Pairs of hex digits, side by side, parted by colons or blanks, or folded; ``0x`` may stand before them.
HEX_ANY = re.compile(r"(?:(?<![0-9A-Za-z])|(?<=0[xX]))[0-9a-fA-F]{2}(?:(?:[:\x20]|[:,]?(?:\r\n?|\n)[\x20\t]*)?[0-9a-fA-F]{2}){23,}(?![0-9A-Za-z])")
PAIR = re.compile("[0-9a-fA-F]{2}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{16,})(?![A-Za-z0-9_-])")


def _der_item(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the element at an offset, if its length fits."""
    if at + 2 > len(data):
        return None
    tag, size, start = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or start + n > len(data):
            return None
        size = int.from_bytes(data[start : start + n], "big")
        start += n
        if size < 0x80:
            return None
    return (tag, start, start + size) if start + size <= len(data) else None


def _der_children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while start < end:
        item = _der_item(data, start)
        if item is None or item[2] > end:
            return None
        out.append(item)
        start = item[2]
    return out


def is_der_key(data: bytes) -> bool:
    """A private or public key: nested lengths that add up, and the members of a key structure."""
    top = _der_item(data, 0)
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = _der_children(data, top[1], top[2])
    if not parts:
        return False
    tags = [p[0] for p in parts]
    if tags[0] == 0x02:
        if len(parts) >= 9 and set(tags[:9]) == {0x02}:  # RSA private key
            return True
        if len(parts) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:  # wrapped private key
            inner = _der_children(data, parts[1][1], parts[1][2])
            return bool(inner) and inner[0][0] == 0x06
        return len(parts) >= 2 and tags[1] == 0x04 and data[parts[0][1] : parts[0][2]] == b"\x01"  # EC private key
    if tags == [0x30, 0x03]:  # public key
        inner = _der_children(data, parts[0][1], parts[0][2])
        return bool(inner) and inner[0][0] == 0x06
    return tags == [0x30, 0x04] and len(data) > 100  # encrypted private key


def is_ssh_key(data: bytes) -> bool:
    """A key in length-prefixed form: the parts' lengths use up the bytes."""
    if data.startswith(b"openssh-key-v1\0"):
        at, fields = 15, 3
    else:
        size = int.from_bytes(data[:4], "big") if len(data) >= 4 else 0
        name = data[4 : 4 + size]
        if not 4 <= size <= 40 or not KEY_NAME.fullmatch(name):
            return False
        at, fields = 0, None
    n = 0
    while at < len(data) and (fields is None or n < fields):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at > len(data):
            return False
        n += 1
    return n >= 2 if fields is None else n == fields


def is_signed_token(header: str, payload: str) -> bool:
    """The first part decodes to a JSON object with an algorithm, the second to a JSON object."""
    try:
        head = json.loads(base64.urlsafe_b64decode(header + "=" * (-len(header) % 4)))
        body = json.loads(base64.urlsafe_b64decode(payload + "=" * (-len(payload) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


class _Bytes:
    """The bytes of base64 letters from one of them on, decoded where they are asked for."""

    def __init__(self, letters: str, at: int):
        self.letters, self.at = letters, at
        n = len(letters) - at
        self.size = n // 4 * 3 + max(0, n % 4 - 1)

    def __call__(self, start: int, end: int) -> bytes:
        end = min(end, self.size)
        if start >= end:
            return b""
        part = self.letters[self.at + start // 3 * 4 : self.at + -(-end // 3) * 4]
        part = part[:-1] if len(part) % 4 == 1 else part
        return base64.b64decode(part + "=" * (-len(part) % 4))[start % 3 : start % 3 + end - start]


def _key_sizes(data: _Bytes) -> Iterator[int]:
    """Sizes in bytes that a key at the start of data may have: by its own lengths, the longest first, then all of data for an SSH head."""
    head = data(0, 48)
    if head[:1] == b"\x30" and len(head) >= 2:
        n = head[1] & 0x7F if head[1] & 0x80 else 0
        yield 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])
        return
    if head.startswith(b"openssh-key-v1\0"):
        at, keys = 15, None
    elif 4 <= (size := int.from_bytes(head[:4], "big")) <= 40 and KEY_NAME.fullmatch(head[4 : 4 + size]):
        at, keys = 0, 0
    else:
        return
    ends: list[int] = []
    fields = 0
    while at + 4 <= data.size:
        size = int.from_bytes(data(at, at + 4), "big")
        if keys is None and fields == 3:  # a count, as many public keys and the private part follow
            keys, at = size, at + 4
            continue
        if keys == 0 and fields >= 2 and 4 <= size <= 40 and KEY_NAME.fullmatch(data(at + 4, at + 4 + size)):
            break  # another key starts
        at, fields = at + 4 + size, fields + 1
        if at > data.size:
            break
        if keys is None or fields < 2:
            continue
        if keys == 0 or fields == 4 + keys:
            ends.append(at)
        if keys and fields == 4 + keys:
            break
    yield from reversed(ends)
    yield data.size


def _folded_keys(text: str, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of the keys in a base64 candidate: each from the start of a line to the end of one."""
    if text[start] in "nr" and text[start - 1 : start] == "\\":
        start += 1  # of an escaped line break before the candidate
    lines, at = [], start
    for fold in FOLDS.finditer(text, start, end):
        lines.append((at, fold.start()))
        at = fold.end()
    stop = end
    while text[stop - 1] == "=":
        stop -= 1
    lines.append((at, stop))
    letters = "".join(text[s:e] for s, e in lines)
    offset, at = [], 0
    for s, e in lines:
        offset.append(at)
        at += e - s
    line_end = {o + e - s: k for k, (o, (s, e)) in enumerate(zip(offset, lines, strict=True))}
    k = 0
    while k < len(lines):
        found = None
        s, e = lines[k]
        for begin in (0, *(m.start() - s for m in INNER.finditer(text, s, e))) if e - s >= 40 else ():
            data = _Bytes(letters, offset[k] + begin)
            for size in _key_sizes(data):
                n = size // 3 * 4 + (0, 2, 3)[size % 3]
                last = line_end.get(data.at + n)
                if last is None and not n % 4:  # one letter more gives no byte
                    last = line_end.get(data.at + n + 1)
                if last is not None and size <= data.size:
                    whole = data(0, size)
                    kind = 3 if is_der_key(whole) else 4 if is_ssh_key(whole) else None
                    if kind is not None:
                        found = (s + begin, kind, last)
                        break
            if found:
                break
        if found is None:
            k += 1
            continue
        first, kind, last = found
        yield first, kind, end if last == len(lines) - 1 else lines[last][1]
        k = last + 1


def _hex_key(text: str, start: int, end: int) -> tuple[int, int, int] | None:
    """(start, kind, end) of a key at the start of a hex candidate: by its own length, if the digits are parted there, else all of it."""
    pairs = [m.start() for m in PAIR.finditer(text, start, end)]
    data = bytes(int(text[p : p + 2], 16) for p in pairs[:48])
    if data[:1] != b"\x30" and not data.startswith(b"openssh-key-v1\0") and not KEY_NAME.match(data[4:]):
        return None
    data = bytes.fromhex("".join(text[p : p + 2] for p in pairs))
    item = _der_item(data, 0)
    size = item[2] if item and item[0] == 0x30 else len(data)
    if size < len(data) and pairs[size] == pairs[size - 1] + 2:
        return None
    kind = 3 if is_der_key(data[:size]) else 4 if is_ssh_key(data) else None
    return None if kind is None else (start, kind, pairs[size - 1] + 2)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base patterns."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates whose decoded bytes have a key's or a token's structure."""
    out = []
    for m in BASE64.finditer(text):
        out += _folded_keys(text, m.start(), m.end())
    out += filter(None, (_hex_key(text, m.start(), m.end()) for m in HEX_ANY.finditer(text)))
    out += [(m.start(), 5, m.end()) for m in TOKEN.finditer(text) if is_signed_token(m[1], m[2])]
    return sorted(out)


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        base, spans, counts = [], [], ([], [], [])
        for text in batch.column("text").to_pylist():
            found = base_spans(text) if text else []
            for kind, column in enumerate(counts):
                column.append(sum(k == kind for _, k, _ in found))
            base.append(hashlib.sha256(spans_text(found).encode()).hexdigest())
            spans.append(spans_text(sorted(found + confirmed_spans(text))) if text else "")
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(spans, pa.string())],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per input row.

    Spans are kind:start:end in code points (end exclusive), by start and then
    kind, comma-joined; base_sha256 covers the three base kinds, spans also the
    confirmed ones.  Spans of different kinds may overlap, and all are reported.  A
    base64 key may be folded by line breaks, real or escaped, with indents, comment
    and quotation marks, or joined from literals, may open behind letters of a path,
    and ends where its own lengths end; hex keys may have 0x before them, colons,
    blanks or line breaks; texts of any length are read whole.  Null and empty texts have none (the hash of no bytes); a
    null doc_id stays null; repeated rows each get their row; further columns of
    docs are ignored; no rows give no rows.
    """
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with every reported span replaced, overlapping ones as one."""
    out, at = [], 0
    for start, _kind, end in sorted(base_spans(text) + confirmed_spans(text)):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    out.append(text[at:])
    return "".join(out)


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        at = batch.schema.get_field_index("text")
        texts = [None if t is None else redacted(t) for t in batch.column("text").to_pylist()]
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The same rows and columns, each reported span of text replaced by a mark, overlapping ones as one.

    Null and empty texts stay as they are; null ids and repeated rows stay; columns
    of any other name stay; no rows give no rows.
    """
    return docs.mapInArrow(_redact, docs.schema)
