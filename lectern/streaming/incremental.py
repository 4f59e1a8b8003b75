"""Stateful behaviour on Structured Streaming: micro-batches, a lease state machine, windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.merge import keep_first


def micro_batches(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of a folder's Parquet files, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def changed_only(rows: DataFrame, known: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows whose content hash is new or differs from the known one."""
    old = known.select(key, F.col(digest).alias("_known"))
    return rows.join(old, key, "left").filter(~F.col(digest).eqNullSafe(F.col("_known"))).drop("_known")


def drained(stream: DataFrame, folder: str, mode: str, keys: list[str]) -> DataFrame:
    """The rows of a stream over what is there, once it has ended: its batches and its checkpoint lie in ``folder``, which all executors share.

    In complete mode these are the last batch's, else the latest of each key.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/{number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("_batch", IntegerType())])).parquet(f"{folder}/rows/*")
    if mode == "complete":
        last = rows.agg(F.max("_batch").alias("_batch"))
        return rows.join(F.broadcast(last), "_batch", "left_semi").drop("_batch")
    return keep_first(rows, keys, [F.desc("_batch")]).drop("_batch")


LEASE_SECONDS = 30 * 60


def _lease(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """PENDING -> PROCESSING -> COMPLETED or FAILED; a lease of 30 minutes without news goes back to PENDING, by its timer if no event comes."""
    status, since = state.get if state.exists else ("PENDING", 0)
    if state.hasTimedOut:
        status, since = "PENDING", since + LEASE_SECONDS
    news = sorted((row for batch in batches for row in zip(batch["at"], batch["event"], strict=True)), key=lambda x: x[0])
    for at, event in news:
        if status == "PROCESSING" and at - since > LEASE_SECONDS:
            status, since = "PENDING", since + LEASE_SECONDS
        if event == "claim" and status in ("PENDING", "FAILED"):
            status, since = "PROCESSING", at
        elif event in ("complete", "fail") and status == "PROCESSING":
            status, since = ("COMPLETED" if event == "complete" else "FAILED"), at
    state.update((status, since))
    if status == "PROCESSING":
        state.setTimeoutTimestamp(max((since + LEASE_SECONDS) * 1000, state.getCurrentWatermarkMs()) + 1)
    yield pd.DataFrame({"id": [key[0]], "status": [status], "since": [since]})


def leases(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The state of each id after its events (columns id, event, at in seconds).

    Event time runs by a watermark ``late`` behind the greatest ``at``: once it
    passes the end of a silent lease, the lease is PENDING again without any event.
    """
    timed = events.withColumn("_at", F.timestamp_seconds("at")).withWatermark("_at", late)
    return timed.groupBy("id").applyInPandasWithState(_lease, "id long, status string, since long", "status string, since long", "update", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, time: str, kind: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of each kind in tumbling windows, closed by a watermark (an extension of the engine)."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
