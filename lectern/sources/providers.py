"""Sources behind an interface: embedding models, text extractors and paged services are passed in as functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[Sequence[str]], np.ndarray]
Extractor = Callable[[bytes], Sequence[str]]


def embed(texts: DataFrame, key: str, text: str, provider: Callable[[], Embedder], size: int, batch: int = 8, most_chars: int = 8000) -> DataFrame:
    """key, embedding (unit length, null where there is no text or it is too long), status.

    provider makes the model once for each task, so that loading it is not paid
    per batch; texts go to it ``batch`` at a time.
    """
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for rows in batches:
            body = rows["text"]
            fit = body.notna() & (body.str.strip() != "") & (body.str.len() <= most_chars)
            vectors: list = [None] * len(rows)
            at = np.flatnonzero(fit.to_numpy(dtype=bool, na_value=False))
            for k in range(0, len(at), batch):
                some = at[k : k + batch]
                got = np.asarray(model([body.iloc[i] for i in some]), np.float64)
                if got.shape != (len(some), size) or not np.isfinite(got).all():
                    raise ValueError(f"the provider gave {got.shape}, not {(len(some), size)} finite numbers")
                got = got / np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-12)
                for i, v in zip(some, got, strict=True):
                    vectors[i] = v.astype(np.float32)
            status = ["COMPLETED" if v is not None else "SKIPPED" for v in vectors]
            yield pd.DataFrame({key: rows["key"], "embedding": vectors, "status": status})

    return texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"{key} {kind}, embedding array<float>, status string")


def extract_pages(files: DataFrame, extractor: Extractor, attempts: int = 2) -> DataFrame:
    """path, page, text, failure of each page that an extractor gives for a file (path, content of a binaryFile read).

    A file whose extractor fails ``attempts`` times gives one row with the failure.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out: list[tuple] = []
            for path, content in zip(rows["path"], rows["content"], strict=True):
                problem = None
                for _ in range(attempts):
                    try:
                        pages = list(extractor(bytes(content)))
                        out += [(path, i + 1, text, None) for i, text in enumerate(pages)]
                        problem = None
                        break
                    except Exception as error:  # an extractor's failure is a row, not the job's end
                        problem = f"{type(error).__name__}: {error}"[:500]
                if problem is not None:
                    out.append((path, 0, None, problem))
            yield pd.DataFrame(out, columns=["path", "page", "text", "failure"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string, failure string")


def paged(pages: DataFrame, number: str, fetch: Callable[[int], Sequence[dict]], schema: str) -> DataFrame:
    """The rows that a paged service gives for page numbers; Spark deals the pages out, so as many are fetched at once as there are partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [row for n in rows[number] for row in fetch(int(n))]
            if found:
                yield pd.DataFrame(found)

    return pages.select(number).mapInPandas(run, schema)
