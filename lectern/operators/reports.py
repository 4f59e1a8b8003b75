"""Reports of several tables whose counters are gathered while the tables are written, so nothing is scanned twice."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_counted(frame: DataFrame, path: str, counters: Mapping[str, Column]) -> dict[str, object]:
    """Writes a table as Parquet and returns the counters (aggregates over its rows) that were gathered on the way."""
    seen = Observation()
    frame.observe(seen, *[c.alias(name) for name, c in counters.items()]).write.parquet(path)
    return seen.get


def validity_row(spark: SparkSession, counts: Mapping[str, int], rules: Mapping[str, bool]) -> DataFrame:
    """One row of all counters (long), whether each rule holds, and ``valid``, whether all do."""
    columns = [F.lit(None if n is None else int(n)).cast("long").alias(name) for name, n in counts.items()]
    judged = [F.lit(bool(ok)).alias(name) for name, ok in rules.items()]
    return spark.range(1).select(*columns, *judged, F.lit(all(rules.values())).alias("valid"))


def _blank(text: str) -> Column:
    return F.coalesce(F.trim(F.col(text)), F.lit("")) == ""


def verification_report(files: DataFrame) -> DataFrame:
    """section, metric, n: the verification of extracted files, from one pass over them and one over their duplicates' keys.

    files: id, program_id, url, active, known_program, status, raw, cleaned,
    extractor, version, failure, attempts, attempted_at, extracted_at, checksum.
    """
    done = F.col("active") & (F.col("status") == "COMPLETED")
    size = lambda c: F.length(F.trim(F.coalesce(c, F.lit(""))))
    in_status = lambda s: F.col("active") & (F.col("status") == s)
    metrics = {
        ("totals", "files"): F.lit(True), ("totals", "active"): F.col("active"), ("totals", "inactive"): ~F.col("active"), ("totals", "orphans"): ~F.col("known_program"),
        **{("status", s): in_status(s) for s in ("PENDING", "PROCESSING", "COMPLETED", "FAILED")},
        ("integrity", "raw_null"): done & F.col("raw").isNull(), ("integrity", "raw_blank"): done & F.col("raw").isNotNull() & (size("raw") == 0), ("integrity", "cleaned_null"): done & F.col("cleaned").isNull(),
        ("integrity", "cleaned_blank"): done & F.col("cleaned").isNotNull() & (size("cleaned") == 0), ("integrity", "raw_under_50"): done & (size("raw") < 50), ("integrity", "raw_under_100"): done & (size("raw") < 100),
        ("integrity", "cleaned_under_50"): done & (size("cleaned") < 50), ("integrity", "cleaned_under_100"): done & (size("cleaned") < 100), ("integrity", "no_extractor"): done & _blank("extractor"), ("integrity", "no_version"): done & _blank("version"),
        ("integrity", "no_extraction_time"): done & F.col("extracted_at").isNull(), ("integrity", "no_attempt_time"): done & F.col("attempted_at").isNull(), ("integrity", "no_attempt"): done & (F.col("attempts") < 1), ("integrity", "failure_named"): done & ~_blank("failure"),
        ("attempts", "two_or_more"): F.col("active") & (F.col("attempts") >= 2), ("attempts", "suspicious"): F.col("active") & (F.col("attempts").isNull() | (F.col("attempts") < 0)),
        ("times", "extracted_before_last_attempt"): done & (F.col("extracted_at") < F.col("attempted_at")), ("times", "pending_but_extracted"): in_status("PENDING") & F.col("extracted_at").isNotNull(), ("times", "failed_without_reason"): in_status("FAILED") & _blank("failure"),
        ("missing", "checksum"): F.col("active") & _blank("checksum"),
    }
    counted = files.agg(*[F.count_if(F.coalesce(rule, F.lit(False))).alias(f"{a}.{b}") for (a, b), rule in metrics.items()])
    as_rows = lambda frame, names: frame.select(F.inline(F.array(*[F.struct(F.lit(n.split(".")[0]).alias("section"), F.lit(n.split(".")[1]).alias("metric"), F.col(f"`{n}`").cast("long").alias("n")) for n in names])))
    out = as_rows(counted, [f"{a}.{b}" for a, b in metrics])
    # Every row stands under each of its three keys once; groups of two or more are duplicates.
    keys = F.array(
        F.struct(F.lit("program_url").alias("kind"), F.concat_ws("|", F.col("program_id").cast("string"), "url").alias("k")), F.struct(F.lit("url").alias("kind"), F.col("url").alias("k")), F.struct(F.lit("checksum").alias("kind"), F.nullif(F.trim("checksum"), F.lit("")).alias("k"))
    )
    groups = files.select("program_id", "active", F.inline(keys)).filter("k IS NOT NULL").groupBy("kind", "k", "program_id").agg(F.count("*").alias("n"), F.bool_or("active").alias("on"), F.bool_or(~F.col("active")).alias("off"))
    groups = groups.groupBy("kind", "k").agg(F.sum("n").alias("n"), F.count("*").alias("programs"), F.bool_or("on").alias("on"), F.bool_or("off").alias("off")).filter("n > 1")
    of = lambda kind, rule=None: F.count_if((F.col("kind") == kind) & (F.lit(True) if rule is None else rule))
    doubles = groups.agg(
        of("program_url").alias("duplicates.program_url_groups"), of("url").alias("duplicates.url_groups"), of("checksum").alias("duplicates.checksum_groups"), F.coalesce(F.sum(F.when(F.col("kind") == "checksum", F.col("n"))), F.lit(0)).alias("duplicates.rows_in_checksum_groups"),
        of("checksum", F.col("programs") < F.col("n")).alias("duplicates.same_program_checksums"), of("checksum", F.col("programs") > 1).alias("duplicates.cross_program_checksums"), of("url", F.col("on") & F.col("off")).alias("duplicates.active_and_inactive_url"),
    )
    return out.unionByName(as_rows(doubles, doubles.columns))
