"""Splitting of long texts into overlapping chunks, and checks of the result."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sanitise

# Characters wished for and allowed in a chunk, of overlap, share of the wish from which a boundary counts, length from which a structured chunk is reported.
TARGET, MOST, OVERLAP, BOUNDARY, LONG = 1500, 2000, 150, 0.6, 4000
# The labels of a chunk's header.
TITLE, AUDIENCE, KIND, UNKNOWN = "프로그램명: ", "대상: ", "청크 유형: ", "정보 없음"
FILE, NO_FILE, PLACE, PART, BODY, SCOPE = "첨부파일명: ", "이름 없음", "첨부파일 순서: ", "파트: ", "[첨부파일 내용]", "회차 범위: 전체 회차"
# Fixed value: characters of chunks that leave the worker at once.
BATCH = 2_000_000
_SENTENCE = re.compile(r"[.!?。！？]")


def _cut(rest: str, wish: int, room: int) -> int:
    """Where a part ends: after the last blank line, else line, else sentence end within the wish and past the share of it; else where room ends."""
    if len(rest) <= room:
        return len(rest)
    least, head = int(BOUNDARY * wish), rest[: min(wish, room)]
    for sign in ("\n\n", "\n"):
        at = head.rfind(sign)
        if at >= least:
            return at + len(sign)
    last = max((m.end() for m in _SENTENCE.finditer(head, least)), default=room)
    return last


def _tail(text: str) -> str:
    """The end of a part that the next one repeats: from the last paragraph that begins in it."""
    value = text[-OVERLAP:].rpartition("\n\n")[2]
    return value if value.strip() else ""


def split_text(text: str, header) -> list[tuple[str, int, int, int]]:
    """(content, start, end, overlap) of the parts of a text.

    header: a function of the part's number and the number of parts, as which the
    estimate is repeated until it holds (four times at most; the last header is
    written with the number of parts that there are).
    """
    total, parts = 1, []
    for _ in range(4):
        parts, at, tail = [], 0, ""
        while at < len(text):
            room = MOST - len(header(len(parts), total)) - 2
            if room - len(tail) <= 0:
                raise ValueError("a chunk's header leaves no room for text")
            wish = max(1, min(TARGET - (MOST - room) - len(tail), room - len(tail)))
            size = _cut(text[at:] if len(text) - at <= MOST else text[at : at + MOST + 1], wish, room - len(tail))
            new = text[at : at + size]
            parts.append(("" if new.startswith(tail) else tail, at, at + size))
            at += size
            tail = _tail(new)
        if len(parts) == total:
            break
        total = len(parts)
    return [(f"{header(k, len(parts))}\n\n{tail}{text[a:b]}", a, b, len(tail)) for k, (tail, a, b) in enumerate(parts)]


def document_chunks(key, title: str, audience: str, core: str, sessions: str, file: str, attachment: str) -> list[tuple]:
    """The chunks of one document, in order: one of the core, one of the sessions, the parts of the attachment."""
    top = lambda kind: [TITLE + (title or UNKNOWN), AUDIENCE + (audience or UNKNOWN), KIND + kind]
    out = []
    for name, kind, more, body in (("core", "CORE", [], core), ("sessions", "SESSIONS", [SCOPE], sessions)):
        if body:
            out.append((name, kind, "\n".join([*top(kind), *more, "", body]), 0, len(body), 0))
    label = file or NO_FILE
    header = lambda k, n: "\n".join([*top("ATTACHMENT"), FILE + label, f"{PLACE}1", f"{PART}{k + 1}/{n}", "", BODY])
    if attachment:
        out += [(f"attachment:{key}:part:{k}", "ATTACHMENT", *part) for k, part in enumerate(split_text(attachment, header))]
    return [(key, n, *row, row[1] != "ATTACHMENT" and len(row[2]) > LONG) for n, row in enumerate(out)]


def in_batches(chunks: Iterable[tuple], most: int = BATCH) -> Iterator[list[tuple]]:
    """Rows of document_chunks in lists that end once their contents reach so many characters, so a worker holds no more of its output."""
    made, size = [], 0
    for chunk in chunks:
        made.append(chunk)
        size += len(chunk[4])
        if size >= most:
            yield made
            made, size = [], 0
    yield made


def chunk_documents(docs: DataFrame, key: str, title: str, audience: str, core: str, sessions: str, file: str, attachment: str) -> DataFrame:
    """key, part, chunk_key, chunk_type, content, source_start, source_end, overlap, long of each chunk of every whole document.

    Texts are sanitised first (an attachment of high risk has none); blank and null
    ones give no chunk.  long marks structured chunks past their warning length.
    """
    types = dict(docs.dtypes)[key]
    names = [key, "part", "chunk_key", "chunk_type", "content", "source_start", "source_end", "overlap", "long"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            safe = ((k, a, b, *(sanitise(text, attached)[0] for text, attached in zip(texts, (False, False, True, True), strict=True))) for k, a, b, *texts in batch.itertuples(index=False, name=None))
            for made in in_batches(chunk for row in safe for chunk in document_chunks(*row)):
                yield pd.DataFrame(made, columns=names)

    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\r\n?", "\n")).alias(f"c_{c}")
    chosen = docs.select(F.col(key).alias("key"), plain(title), plain(audience), *(F.col(c).alias(name) for c, name in ((core, "core"), (sessions, "sessions"), (file, "file"), (attachment, "attachment"))))
    return chosen.mapInPandas(run, f"{key} {types}, part int, chunk_key string, chunk_type string, content string, source_start int, source_end int, overlap int, long boolean")


def chunk_problems(chunks: DataFrame, key: str) -> DataFrame:
    """Broken rules per document: repeated keys, gaps in the order, chunks over the limit."""
    w = Window.partitionBy(key, "chunk_key")
    x = chunks.withColumn("_same", F.count("*").over(w))
    g = x.groupBy(key).agg(F.max("_same").alias("same"), F.max("part").alias("last"), F.count("*").alias("n"), F.max(F.when(F.col("chunk_type") == "ATTACHMENT", F.length("content"))).alias("longest"))
    codes = F.array_compact(F.array(F.when(F.col("same") > 1, "DUPLICATE_CHUNK_KEY"), F.when(F.col("last") + 1 != F.col("n"), "GAP"), F.when(F.col("longest") > MOST, "TOO_LONG")))
    return g.select(key, codes.alias("problems")).filter(F.size("problems") > 0)
