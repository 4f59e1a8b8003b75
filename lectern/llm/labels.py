"""Held-out folds and bounded samples of labelled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def held_out(doc_id: Column, modulus: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in the fold (a null id does not)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == fold, F.lit(False))


def passage(text: Column, doc_id: Column, max_chars: int) -> Column:
    """The text, or of a longer one ``max_chars`` characters from a place that the id's hash chooses."""
    start = F.pmod(F.xxhash64(doc_id, F.lit(max_chars)), F.greatest(F.lit(1), F.length(text) - max_chars + 1)) + 1
    return F.when(F.length(text) <= max_chars, text).otherwise(F.substring(text, start.cast("int"), F.lit(max_chars)))


def labelled_sample(rows: DataFrame, label: str, per_label: int, max_chars: int) -> tuple[dict[object, list[tuple[int, str]]], dict[object, int]]:
    """At most ``per_label`` (doc_id, text) for each label value, and how many rows each value has.

    Those of the smallest id hashes, so the sample does not depend on the
    partitioning.  No text is too long to be learned from: of one over
    ``max_chars`` characters a passage of that length is taken.  What comes to the
    driver is in proportion to ``per_label`` times the number of label values.
    """
    able = rows.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    able = able.select("doc_id", F.col(label).alias("label"), "text")
    counts = {r.label: r["count"] for r in able.groupBy("label").count().collect()}
    if not counts:
        return {}, {}
    # Hashes under a share of the range that holds about twice the rows asked for:
    # the smallest of them are the smallest of all.
    limits = [(name, min(2**63 - 1, int(-(2**63) + min(1.0, 2 * (per_label + 32) / n) * 2**64))) for name, n in counts.items()]
    kind = T.StructType([T.StructField("label", able.schema["label"].dataType), T.StructField("most", T.LongType())])
    low = able.join(F.broadcast(rows.sparkSession.createDataFrame(limits, kind)), "label").withColumn("h", F.xxhash64("doc_id")).filter("h <= most")
    best: dict[object, list[tuple[int, int]]] = {name: [] for name in counts}
    for r in low.select("label", "doc_id", "h").distinct().collect():
        best[r.label].append((r.h, r.doc_id))
    pairs = {(name, i) for name, found in best.items() for _, i in sorted(found)[:per_label]}
    texts: dict[object, set[tuple[int, str]]] = {name: set() for name in counts}
    # A list of ids is pushed down to the scan, below any join that ``rows`` has.
    for r in able.filter(F.col("doc_id").isin(sorted({i for _, i in pairs}))).select("label", "doc_id", passage(F.col("text"), F.col("doc_id"), max_chars).alias("text")).distinct().collect():
        if (r.label, r.doc_id) in pairs:
            texts[r.label].add((r.doc_id, r.text))
    return {name: sorted(texts[name])[:per_label] for name in sorted(texts)}, counts
