"""Programme search over vectors: the guarded chunk search, the re-ranked board search and the embedding plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import programmes as P
from ..functions.vectors import cosine, dot
from .ranking import type_priority

# Least ranking score, least share of the best similarity, and the concept coverage asked of up to two or more concepts.
LEAST_SCORE, FLOOR, COVERAGE_FEW, COVERAGE_MANY = 0.45, 0.85, 1.0, 0.66
# Candidates fetched for each result, at least; minutes for which a claim is recent.
OVER_FETCH, LEAST_FETCH, RECENT_MINUTES = 5, 20, 30


def board_search(items: DataFrame, vector: DataFrame, query: str, limit: int = 50, audience: str | None = None) -> DataFrame:
    """rank, source_id, series, series_count, similarity, ranking_score, adjustments and concepts of the best item of each series.

    items: source_id, title, target, summary, embedding.  vector: one row with the
    query's ``vector``; none gives no result.  Items are filtered by the chosen
    audience (those for all always stay), scored, held to the least score, to
    compatible audiences, to the concept coverage and to a share of the best
    similarity left, and collapsed by series.  Only that best similarity, one row,
    is broadcast back.
    """
    found = items.withColumn("audiences", P.document_audiences(F.col("target")))
    if audience:
        found = found.filter(F.arrays_overlap("audiences", F.array(*map(F.lit, (*P.AUDIENCE_FILTERS[audience], "general")))))
    asked = P.concepts_of(query)
    n = sum(map(len, asked.values()))
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    match = P.concept_adjustment(asked, {group: P.concepts(text, group) for group in P.CONCEPTS})
    scored = found.join(F.broadcast(vector.select("vector")), how="cross").select(
        "source_id", P.series_key(F.col("title"), F.col("audiences")).alias("series"), F.round(dot(F.col("embedding"), F.col("vector")), 8).alias("similarity"),
        P.audience_adjustment(P.query_audience_of(query), F.col("audiences")).alias("fit"), match.alias("match"),
    )
    score = F.round(F.round(F.col("similarity") + F.col("fit.adjustment"), 8) + F.col("match.adjustment"), 8)
    covered = F.col("match.coverage") >= (COVERAGE_FEW if n <= 2 else COVERAGE_MANY) if n else F.lit(True)
    eligible = scored.withColumn("ranking_score", score).filter((F.col("ranking_score") >= LEAST_SCORE) & (F.col("fit.adjustment") > -0.25) & covered)
    near = eligible.join(F.broadcast(eligible.agg(F.max("similarity").alias("top"))), how="cross").filter(F.col("similarity") >= F.col("top") * FLOOR)
    order = (F.desc("ranking_score"), F.desc("similarity"), F.asc("source_id"))
    per = Window.partitionBy("series")
    best = near.withColumn("r", F.row_number().over(per.orderBy(*order))).withColumn("series_count", F.count("*").over(per)).filter("r = 1")
    top = best.orderBy(*order).limit(limit)  # at most so many rows are ranked in one task
    return top.select(
        F.row_number().over(Window.orderBy(*order)).alias("rank"), "source_id", "series", "series_count", "similarity", "ranking_score",
        F.col("fit.adjustment").alias("audience_adjustment"), F.col("fit.reason").alias("audience_match"),
        F.col("match.adjustment").alias("concept_adjustment"), F.col("match.coverage").alias("concept_coverage"), F.col("match.matched").alias("matched"), F.col("match.missing").alias("missing"),
    )


def current(metadata: Mapping[str, object]) -> Column:
    """Whether a chunk's embedding is complete and of the provider, model, revision, version, dimension and text that are asked for."""
    same = [F.col(name) == F.lit(value) for name, value in metadata.items()]
    out = (F.col("status") == "COMPLETED") & (F.col("embedded_hash") == F.col("content_hash"))
    for guard in same:
        out = out & guard
    return F.coalesce(out, F.lit(False))


def chunk_search(rows: DataFrame, vector: DataFrame, metadata: Mapping[str, object], limit: int = 5, threshold: float | None = None, kind: str | None = None, target: str | None = None) -> DataFrame:
    """rank, program_id, chunk_id, chunk_type, similarity of the best chunk of each of the nearest programs, with the counts of the search.

    rows: the embedding with its identity columns (see ``current``), chunk_id,
    chunk_type, program_id, target.  Several times the limit is fetched by distance,
    then collapsed by program: candidates and programs count what was fetched.
    """
    guarded = rows.filter(current(metadata) & F.col("embedding").isNotNull())
    near = guarded.join(F.broadcast(vector.select("vector")), how="cross").withColumn("similarity", cosine(F.col("embedding"), F.col("vector")))
    if threshold is not None:
        near = near.filter(F.col("similarity") >= threshold)
    if kind is not None:
        near = near.filter(F.col("chunk_type") == kind)
    if target is not None:
        near = near.filter(F.locate(target.lower(), F.lower("target")) > 0)
    near = near.orderBy(F.desc("similarity"), "chunk_id").limit(max(OVER_FETCH * limit, LEAST_FETCH))
    order = (F.desc("similarity"), F.asc(type_priority(F.col("chunk_type"))), F.asc("chunk_id"))
    counts = near.agg(F.count("*").alias("candidates"), F.count_distinct("program_id").alias("programs"))
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("program_id").orderBy(*order))).filter("r = 1")
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).filter(F.col("rank") <= limit)
    return best.join(F.broadcast(counts), how="cross").select("rank", "program_id", "chunk_id", "chunk_type", "similarity", "candidates", "programs")


def embedding_action(metadata: Mapping[str, object], now: Column) -> Column:
    """What an incremental embedding run does with a chunk: the first rule that holds.

    Columns: content, exists, status, attempted_at and the identity columns of ``current``.
    """
    recent = (F.col("status") == "PROCESSING") & (F.col("attempted_at") >= now - F.expr(f"INTERVAL {RECENT_MINUTES} MINUTES"))
    exists = F.coalesce("exists", F.lit(False))
    return (
        F.when(~F.coalesce("content", F.lit("")).rlike(r"[^\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"), "skipped_empty").when(F.coalesce(recent, F.lit(False)), "skipped_recent_processing")
        .when(exists & current(metadata), "unchanged").when(exists, "would_update").otherwise("would_create")
    )
