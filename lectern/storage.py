"""Where written tables and stream states lie."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one the cluster names in spark.checkpoint.dir; a temporary one only in local mode, where none is set."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(known or tempfile.mkdtemp(prefix='lectern-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint, for what several later steps read."""
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        known = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(known or work_folder(frame.sparkSession, "checkpoints"))
    return frame.checkpoint(eager=True)


def stored(frame: DataFrame, name: str = "stored") -> DataFrame:
    """The same rows, written once as compressed columns to the shared folder: for many rows that several later steps read some columns of."""
    folder = work_folder(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)
