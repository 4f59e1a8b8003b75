"""A training corpus in five stages, each on all that the one before it kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), where
docs has the columns of ``documents``, and returns a DataFrame that is written
as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.bpe import bpe_encode
from lectern.llm.decontaminate import drop_contaminated
from lectern.llm.language_id import keep_identified
from lectern.llm.near_dedup import near_duplicates
from lectern.llm.secret_scan import redact_secrets
from lectern.llm.session import cut, shared_folder

#: SQL cannot express the learned language stage; tests hold the stages against brute force.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, lang set to it; ``und`` documents (null text, no letter) are rejected.

    Null ids and repeated rows are told like any others; other columns stay.  Where
    no row has a lang nothing can be told: a warning, and documents with a letter
    stay as they are.  No rows give no rows.
    """
    return keep_identified(docs)


#: Ids that go, up to which they are broadcast to the texts; more of them are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more): the one of the smallest doc_id.

    Rows with a null doc_id take no part and stay.  Of rows that repeat a doc_id one
    stays (the smallest by all its columns), if its group keeps that doc_id at all.
    Null, empty and wordless texts are in no group and stay.  No rows give no rows.
    """
    found = near_duplicates(docs, percent=80)
    ids = cut(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).filter("n > 1 OR NOT kept"))
    few = ids.count() <= BROADCAST_ROWS
    out = docs.join(F.broadcast(ids.select("doc_id")) if few else ids.select("doc_id"), "doc_id", "left_anti")
    again = ids.filter("kept").select("doc_id")
    if again.limit(1).count():
        repeated = docs.join(F.broadcast(again) if few else again, "doc_id", "left_semi")
        out = out.unionByName(repeated.groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*"))
    return out.select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    A row goes by its text alone, so null ids and repeated rows are judged like any
    others; null and empty texts stay.  No rows, or no benchmark, change nothing.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each reported secret replaced by a mark, n_chars counted again.

    Null and empty texts stay as they are, a null text's n_chars too; null ids and
    repeated rows stay.  No rows give no rows.
    """
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the token ids of every document (a null text has none).

    Null ids stay null, repeated rows each get their row.  No rows give no rows.
    """
    return bpe_encode(docs, with_ids=True)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("byte_bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each but the last through a written table in the shared folder.

    The tables of a run lie in a folder of its own name, corpus-<hex>, so runs do not
    meet and a failed one can be looked into; whoever runs it removes them.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
