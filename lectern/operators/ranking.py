"""Ranked retrieval: top-k, collapsing, fusion, lexical scores and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from ..functions.vectors import cosine
from ..storage import cut


def nearest(rows: DataFrame, vector: str, query: Sequence[float] | DataFrame, key: str, size: int) -> DataFrame:
    """The exact top rows by cosine similarity, ties by key.

    query: the numbers, or a frame whose one row holds them as ``vector`` (without a row nothing is near).
    """
    if isinstance(query, DataFrame):
        held = rows.join(F.broadcast(query.select(F.col("vector").alias("_q"))), how="cross")
    else:
        held = rows.withColumn("_q", F.array(*[F.lit(float(x)) for x in query]))
    return held.withColumn("similarity", cosine(F.col(vector), F.col("_q"))).drop("_q").orderBy(F.desc("similarity"), F.asc(key)).limit(size)


def best_of_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The best row of each group and the group's size."""
    w = Window.partitionBy(*group)
    ranked = rows.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("group_size", F.count("*").over(w))
    return ranked.filter("_r = 1").drop("_r")


def ranked(rows: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "rank", limit: int | None = None) -> DataFrame:
    """Ranks from 1 in a total order, within ``by`` if given."""
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out.filter(F.col(name) <= limit) if limit else out


def global_rank(rows: DataFrame, by: Column, order: Sequence[Column], name: str = "rank", buckets: int = 64) -> DataFrame:
    """Ranks from 1 over all rows in a total order that begins with the ascending numeric ``by``; nulls come last.

    Rows are dealt to ranges of the whole order (so rows that tie on ``by`` are in
    several), ranked inside their range, and moved up by what the ranges before
    hold; no task sees all rows.  The ranges are sampled, hence written once.
    """
    whole = [F.col("_by").asc_nulls_last(), *order]
    dealt = cut(rows.withColumn("_by", by.cast("double")).repartitionByRange(buckets, *whole).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))  # a row for each of a fixed number of ranges
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*whole))
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, inside + F.col("_before")).drop("_by", "_part", "_before")


def lexical_statistics(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Postings (key, term, tf, length) and document frequencies (term, df)."""
    words = docs.select(key, terms(F.col(text)).alias("terms"))
    one = words.select(key, F.size("terms").alias("length"), F.explode("terms").alias("term"))
    postings = one.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    return postings, postings.groupBy("term").agg(F.count("*").alias("df"))


def bm25(docs: DataFrame, key: str, text: str, query: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key and score of the documents that have any of the query's distinct terms.

    One pass over the documents gives a row of corpus statistics, one the scores,
    without a shuffle; either splits a text once.  A count is what a list of terms
    loses with the term, which, unlike a filter by a lambda, is compiled.
    """
    wanted = sorted(set(query))
    flat = F.trim(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " "))
    words = docs.select(key, F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " ")).alias("terms"))
    counts = [(F.size("terms") - F.size(F.array_remove("terms", F.lit(w)))).alias(f"_tf{i}") for i, w in enumerate(wanted)]
    counted = words.select(key, F.size("terms").alias("length"), *counts)
    df = [F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(wanted))]
    stats = counted.agg(F.count("*").alias("_n"), F.avg("length").alias("_mean"), *df)
    n, norm = F.col("_n"), k1 * (1 - b + b * F.col("length") / F.col("_mean"))
    score = F.lit(0.0)
    for i in range(len(wanted)):
        f, held = F.col(f"_tf{i}"), F.col(f"_df{i}")
        score = score + F.when(f > 0, F.log(1 + (n - held + 0.5) / (held + 0.5)) * f * (k1 + 1) / (f + norm)).otherwise(0.0)
    # The condition needs the statistics, so it stays above the join and splits no text again.
    return counted.join(F.broadcast(stats), how="cross").select(key, score.alias("score")).filter("score > 0")  # one row of statistics


def hybrid_search(lexical: DataFrame, dense: DataFrame, records: DataFrame, key: str, method: str, limit: int, age: str | None = None, grade: int | None = None) -> DataFrame:
    """rank, key, group_id, bm25_rank, dense_rank, bm25_score, similarity, rrf_score, boosts of the best records of a search.

    lexical: key, rank, score.  dense: key, rank, similarity.  records: key, group_id,
    ages (array), grade_min, grade_max.  method: BM25 and DENSE rank their own list,
    HYBRID the union by reciprocal ranks, HYBRID_TARGETED with a boost for the asked
    age group.  A record whose grade range lacks the asked grade is left out; one
    without a range stays.
    """
    lex = lexical.select(key, F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    near = dense.select(key, F.col("rank").alias("dense_rank"), "similarity")
    how = {"BM25": "left", "DENSE": "right"}.get(method, "full_outer")
    found = lex.join(near, key, how).join(records, key)
    share = lambda c: F.coalesce(1.0 / (F.lit(60) + F.col(c)), F.lit(0.0))
    fits = F.coalesce(F.array_contains("ages", age), F.lit(False)) if method == "HYBRID_TARGETED" and age else F.lit(False)
    rrf = share("bm25_rank") + share("dense_rank") + F.when(fits, 0.002).otherwise(0.0)
    if grade is not None:
        found = found.filter(F.coalesce((F.col("grade_min") <= grade) & (F.col("grade_max") >= grade), F.lit(True)))
    score = {"BM25": F.coalesce("bm25_score", F.lit(0.0)), "DENSE": F.coalesce("similarity", F.lit(-1.0))}.get(method, rrf)
    boosts = F.when(fits, F.array(F.lit("TARGET_AGE_GROUP:+0.002"))).otherwise(F.array().cast("array<string>"))
    hybrid = rrf if method.startswith("HYBRID") else F.lit(None).cast("double")
    x = found.select(key, "group_id", "bm25_rank", "dense_rank", "bm25_score", "similarity", hybrid.alias("rrf_score"), boosts.alias("boosts"), F.round(score, 9).alias("_score"))
    order = (F.desc("_score"), F.asc("group_id"), F.asc(key))
    top = x.orderBy(*order).limit(limit)  # at most so many rows are ranked in one task
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("_score")


def reciprocal_rank_fusion(lists: Sequence[DataFrame], key: str, rank: str = "rank", k: int = 60) -> DataFrame:
    """key and the sum of 1 / (k + rank) over ranked lists."""
    out = lists[0].select(key, (1.0 / (F.lit(k) + F.col(rank))).alias("score"))
    for more in lists[1:]:
        out = out.unionByName(more.select(key, (1.0 / (F.lit(k) + F.col(rank))).alias("score")))
    return out.groupBy(key).agg(F.sum("score").alias("score"))


def floor_of_best(rows: DataFrame, by: Sequence[str], score: str, share: float) -> DataFrame:
    """Rows at or above a share of their group's best score."""
    top = F.max(score).over(Window.partitionBy(*by))
    return rows.withColumn("_top", top).filter(F.col(score) >= share * F.col("_top")).drop("_top")


def retrieval_metrics(rows: DataFrame, query: str, rank: str, relevance: str, key: str) -> DataFrame:
    """P@5, nDCG@5, MRR, Success@3 and mean relevance of every query whose rows are all judged."""
    w = Window.partitionBy(query)
    judged = rows.withColumn("_all", F.count("*").over(w)).withColumn("_known", F.count(relevance).over(w)).filter("_all = _known")
    gain = F.pow(F.lit(2.0), F.col(relevance)) - 1
    ideal = F.row_number().over(w.orderBy(F.desc(relevance), F.asc(key)))
    x = judged.withColumn("_ideal", ideal)
    at5, good = F.col(rank) <= 5, F.col(relevance) >= 2
    m = x.groupBy(query).agg(
        (F.sum(F.when(at5 & good, 1).otherwise(0)) / 5.0).alias("precision_at_5"),
        F.sum(F.when(at5, gain / F.log2(F.col(rank) + 1.0)).otherwise(0.0)).alias("_dcg"),
        F.sum(F.when(F.col("_ideal") <= 5, gain / F.log2(F.col("_ideal") + 1.0)).otherwise(0.0)).alias("_ideal_dcg"),
        F.coalesce(1.0 / F.min(F.when(at5 & good, F.col(rank))), F.lit(0.0)).alias("reciprocal_rank"),
        F.max(F.when((F.col(rank) <= 3) & good, 1).otherwise(0)).alias("success_at_3"),
        (F.sum(F.when(at5, F.col(relevance)).otherwise(0)) / 5.0).alias("mean_relevance"),
    )
    ndcg = F.when(F.col("_ideal_dcg") > 0, F.col("_dcg") / F.col("_ideal_dcg")).otherwise(0.0)
    return m.select(query, "precision_at_5", F.round(ndcg, 6).alias("ndcg_at_5"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"), "success_at_3", "mean_relevance")


#: Weights of chunk types, the second chunk's factor, and label bonuses (age, category, participation, operation).
POLICIES = {
    "baseline": ((1.0, 1.0, 1.0), 0.0, (0.0, 0.0, 0.0, 0.0), False),
    "metadata": ((1.0, 1.0, 1.0), 0.0, (0.04, 0.04, 0.03, 0.02), False),
    "weighted": ((1.0, 0.98, 0.95), 0.0, (0.0, 0.0, 0.0, 0.0), False),
    "aggregate": ((1.0, 1.0, 1.0), 0.10, (0.0, 0.0, 0.0, 0.0), False),
    "combined": ((1.0, 0.98, 0.95), 0.10, (0.04, 0.04, 0.03, 0.02), True),
}
TYPES = ("CORE", "SESSIONS", "ATTACHMENT")


def type_priority(kind: Column) -> Column:
    out = F.lit(9)
    for i, name in reversed(list(enumerate(TYPES))):
        out = F.when(kind == name, F.lit(i)).otherwise(out)
    return out


def policy_rank(candidates: DataFrame, policy: str, requested: dict[str, Sequence[str]] | None = None, limit: int | None = None) -> DataFrame:
    """Programs ranked by a policy, from chunk candidates.

    candidates: program_id, chunk_id, chunk_type, similarity and, for label
    bonuses, array columns ages, categories, participation, operation (UNKNOWN
    counts as no label).
    """
    weights, second, bonuses, hard = POLICIES[policy]
    weight = F.lit(1.0)
    for name, w in zip(TYPES, weights, strict=True):
        weight = F.when(F.col("chunk_type") == name, F.lit(w)).otherwise(weight)
    per = Window.partitionBy("program_id")
    c = candidates.withColumn("_p", type_priority(F.col("chunk_type"))).withColumn("_adj", F.col("similarity") * weight)
    c = c.withColumn("_rep", F.row_number().over(per.orderBy(F.desc("similarity"), "_p", "chunk_id"))).withColumn("_a", F.row_number().over(per.orderBy(F.desc("_adj"), "_p", "chunk_id")))
    c = c.withColumn("_a1", F.max(F.when(F.col("_a") == 1, F.col("_adj"))).over(per)).withColumn("_a2", F.max(F.when(F.col("_a") == 2, F.col("_adj"))).over(per))
    one = c.filter("_rep = 1")
    bonus, keep = F.lit(0.0), F.lit(True)
    for axis, value in zip(("ages", "categories", "participation", "operation"), bonuses, strict=True):
        asked = [x for x in (requested or {}).get(axis, ()) if x != "UNKNOWN"]
        if not asked or axis not in candidates.columns:
            continue
        known = F.filter(axis, lambda x: x != "UNKNOWN")
        same = F.when(F.size(known) > 0, F.arrays_overlap(known, F.array(*map(F.lit, asked))))
        bonus = bonus + F.when(same, F.lit(value)).otherwise(0.0)
        keep = keep & F.coalesce(same, F.lit(True)) if hard else keep
    scored = one.withColumn("score", F.col("_a1") + F.coalesce(F.least("_a2", "_a1"), F.lit(0.0)) * second + bonus).filter(keep)
    # Nine digits: sums in another order may differ past them.
    order = (F.desc(F.round("score", 9)), F.desc(F.round("similarity", 9)), F.asc("_p"), F.asc("program_id"), F.asc("chunk_id"))
    if limit:
        out = ranked(scored.orderBy(*order).limit(limit), order)
    else:
        out = global_rank(scored, -F.round("score", 9), order).withColumn("rank", F.col("rank").cast("int"))
    return out.select("rank", "program_id", "chunk_id", "chunk_type", "similarity", "score")
