"""A table of one row a key in hashed buckets, whose versions are manifests: batches rewrite the buckets they touch, readers stay on the version they took."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.files import path_of, publish, read_text


class ConcurrentWrite(RuntimeError):
    """Another writer has committed the version that this one was about to."""


class KeyedTable:
    """Rows by key under a folder that all executors share.

    ``data/<id>/bucket=<n>`` holds the rows of one bucket as one commit wrote
    them; ``manifests/<version>.json`` names the folder of each bucket and the last
    batch of each stream.  A version is committed by renaming its manifest into
    place, which fails if it is there already, so a reader sees a batch whole or
    not at all, and a batch that is run again changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, keys: list[str], order: str, buckets: int = 64):
        self.spark, self.folder, self.keys, self.order, self.buckets = spark, folder.rstrip("/"), keys, order, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        files, path = path_of(self.spark, f"{self.folder}/manifests")
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, version: int | None = None) -> dict:
        """What a version (the latest) holds; an empty one before the first commit."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "buckets": {}, "streams": {}}
        return json.loads(read_text(self.spark, f"{self.folder}/manifests/{known[-1] if version is None else version:010d}.json"))

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the latest now), whatever is committed later."""
        return self._rows(self.manifest(version)["buckets"].values())

    def _rows(self, folders) -> DataFrame:
        paths = sorted(folders)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _latest(self, rows: DataFrame) -> DataFrame:
        """One row a key: the greatest ``order``, then the greatest by all columns, so a batch that is run again chooses as before."""
        whole = F.struct(*self.schema.names)
        best = F.max_by(whole, F.struct(F.col(self.order), F.to_json(F.struct(*sorted(self.schema.names)))))
        return rows.groupBy(*self.keys).agg(best.alias("_row")).select("_row.*")

    def upsert(self, batch: DataFrame, stream: str | None = None, number: int | None = None, attempts: int = 3) -> int:
        """Commits the latest row of each key over what is there, and returns the version.

        stream, number: the batch's place in a stream; one that a version has seen
        is passed over.  Only buckets that a key of the batch falls into are read and
        written.  Rows with a null key or order take no part.
        """
        whole = batch.select(*self.schema.names)
        for c in {*self.keys, self.order}:
            whole = whole.filter(F.col(c).isNotNull())
        whole = whole.persist()
        try:
            for attempt in range(attempts):
                try:
                    return self._commit(whole, stream, number)
                except ConcurrentWrite:
                    if attempt == attempts - 1:
                        raise
            raise ValueError("attempts must be 1 or more")
        finally:
            whole.unpersist()

    def _commit(self, batch: DataFrame, stream: str | None, number: int | None) -> int:
        now = self.manifest()
        if stream is not None and number is not None and now["streams"].get(stream, -1) >= number:
            return now["version"]
        touched = [str(r.b) for r in batch.select(self._bucket().alias("b")).distinct().collect()]  # at most ``buckets`` numbers
        kept = dict(now["buckets"])
        if touched:
            held = self._rows(kept[b] for b in touched if b in kept)
            made = self._latest(held.unionByName(batch)).withColumn("bucket", self._bucket())
            folder = f"{self.folder}/data/{uuid.uuid4().hex}"
            made.repartition("bucket").write.partitionBy("bucket").parquet(folder)
            kept.update({b: f"{folder}/bucket={b}" for b in touched})
        streams = now["streams"] if stream is None else {**now["streams"], stream: number}
        version = now["version"] + 1
        if not publish(self.spark, f"{self.folder}/manifests/{version:010d}.json", json.dumps({"version": version, "buckets": kept, "streams": streams}, sort_keys=True)):
            raise ConcurrentWrite(f"version {version} of {self.folder}")
        return version

    def sink(self, stream: str) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function that upserts a stream's batches."""

        def write(batch: DataFrame, number: int) -> None:
            self.upsert(batch, stream, number)

        return write

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes all but the last ``keep`` versions and every data folder that none of those names; what was deleted.

        For when no reader holds an older version and no writer is at work.
        """
        known = self.versions()
        last = known[-keep:] if keep else []
        used = {f.rsplit("/", 2)[-2] for v in last for f in self.manifest(v)["buckets"].values()}
        files, data = path_of(self.spark, f"{self.folder}/data")
        gone = [str(s.getPath()) for s in (files.listStatus(data) if files.exists(data) else []) if s.getPath().getName() not in used]
        gone = [f"{self.folder}/manifests/{v:010d}.json" for v in known if v not in last] + gone
        for name in gone:
            files.delete(path_of(self.spark, name)[1], True)
        return gone
