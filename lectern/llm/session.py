"""Small session helpers of the text operators."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only in local mode, where none is set (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not known:
        known = tempfile.mkdtemp(prefix="lectern-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(known)
    return known


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Frames made inside drop their shuffle files as soon as their action ends."""
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)


def cut(frame: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint."""
    shared_folder(frame.sparkSession)
    with tidy(frame.sparkSession):
        return frame.select("*").checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(batch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).to_pylist()


#: Rows and bytes of variable length of one slice (a longer row goes alone).
PIECE_ROWS, PIECE_BYTES = 1024, 4_000_000


def _weights(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of variable length of each row."""
    out = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            out += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return out


def pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE_ROWS, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of record batches of bounded rows and bytes, so that what a task makes of a batch at once stays small.

    At the end freed memory goes back to the system: a worker that waits for its next task holds none of it.
    """
    for batch in batches:
        edge, at = np.cumsum(_weights(batch)), 0
        while at == 0 or at < batch.num_rows:
            full = int(np.searchsorted(edge, (edge[at - 1] if at else 0) + size, side="right"))
            to = min(batch.num_rows, at + rows, max(at + 1, full))
            yield batch.slice(at, to - at)
            at = max(1, to)
        del batch
    release()


def release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
