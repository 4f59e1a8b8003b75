"""Entity grouping: buckets by key, split greedily by pairwise incompatibility."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_entities(rows: DataFrame, key: str, bucket: str, kind: str, blocked: DataFrame, score: str) -> DataFrame:
    """key, group_id, representative, members, confidence.

    Inside a bucket, rows in key order join the first group whose every member
    has the same kind and no blocking link (columns a, b of ``blocked``) with
    them.  Rows with an empty bucket stay alone.  Only the links inside a bucket
    travel with it; the representative has the best score, ties to the smaller key.
    """
    alone = F.concat(F.lit("single:"), F.col(key).cast("string"))
    base = rows.select(F.col(key).alias("key"), F.when(F.coalesce(F.col(bucket), F.lit("")) == "", alone).otherwise(F.col(bucket)).alias("bucket"), F.col(kind).alias("kind"), F.col(score).cast("double").alias("score"))
    both = blocked.select("a", "b").unionByName(blocked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.groupBy(F.col("a").alias("key")).agg(F.collect_set("b").alias("never"))
    ready = base.join(links, "key", "left")
    # Buckets of one kind without any link need no search: they are one group.
    plain = ready.groupBy("bucket", "kind").agg(F.count("never").alias("links"))
    easy = plain.groupBy("bucket").agg(F.sum("links").alias("links"))
    with_flag = ready.join(easy, "bucket")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        groups: list[tuple[str, list, set]] = []
        out = []
        for k, never in zip(pdf["key"], pdf["never"], strict=True):
            bad = set(never) if never is not None else set()
            place = next((i for i, (_, members, banned) in enumerate(groups) if k not in banned and not bad.intersection(members)), None)
            if place is None:
                groups.append(("", [], set()))
                place = len(groups) - 1
            groups[place][1].append(k)
            groups[place][2].update(bad)
            out.append(place)
        return pd.DataFrame({"key": pdf["key"], "bucket": pdf["bucket"], "kind": pdf["kind"], "score": pdf["score"], "part": out})

    types = dict(base.dtypes)
    schema = f"key {types['key']}, bucket string, kind {types['kind']}, score double, part int"
    hard = with_flag.filter("links > 0").groupBy("bucket", "kind").applyInPandas(assign, schema)
    soft = with_flag.filter("links = 0").select("key", "bucket", "kind", "score", F.lit(0).alias("part"))
    placed = hard.unionByName(soft)
    g = placed.groupBy("bucket", "kind", "part").agg(F.max_by("key", F.struct("score", -F.col("key"))).alias("representative"), F.array_sort(F.collect_set("key")).alias("members"))
    g = g.withColumn("group_id", F.substring(F.sha2(F.concat_ws("|", "bucket", "kind", F.array_join(F.transform("members", lambda m: m.cast("string")), ",")), 256), 1, 32))
    confidence = F.when(F.size("members") > 1, "HIGH").otherwise("MEDIUM")
    return placed.select("key", "bucket", "kind", "part").join(g, ["bucket", "kind", "part"]).select(F.col("key").alias(key), "group_id", "representative", F.size("members").alias("members"), confidence.alias("confidence"))
