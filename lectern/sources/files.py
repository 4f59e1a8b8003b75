"""File sources with declared schemas: JSON documents, JSON lines, unions of files, the latest file, optional inputs; and files that appear whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_records(spark: SparkSession, path: str, record: str, field: str = "records") -> DataFrame:
    """The rows of an array field of whole JSON documents. record: DDL of one row."""
    return spark.read.schema(f"{field} array<struct<{record}>>").json(path, multiLine=True).select(F.inline(field))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines, blank lines skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("row")).select("row.*")


def union_files(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows under the union of their columns, missing ones null."""
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def latest_file(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The greatest path by name among a folder's matching files, from the listing alone."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return listed.agg(F.max("path")).first()[0]


def optional_parquet(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A table, or no rows of its schema where the path does not exist."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem.getCondition()):
            raise
        return spark.createDataFrame([], schema)


def split_known(rows: DataFrame, artifacts: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose artifact of the same keys exists, rows still to do)."""
    known = artifacts.select(*keys).distinct()
    return rows.join(known, list(keys), "left_semi"), rows.join(known, list(keys), "left_anti")


def file_kind(content):
    """Kind of a file by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit("unknown")
    # Leading bytes of common formats.
    for magic, kind in (("25504446", "pdf"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("504B0304", "zip"), ("D0CF11E0A1B11AE1", "ole"), ("47494638", "gif"), ("50415231", "parquet")):
        out = F.when(head.startswith(magic), F.lit(kind)).otherwise(out)
    return out


def path_of(spark: SparkSession, path: str):
    """(file system, path) of a path in whatever store its scheme names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    files, where = path_of(spark, path)
    stream = files.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Whether a file or folder could be moved to a name that was free."""
    files, where = path_of(spark, source)
    _, to = path_of(spark, target)
    files.mkdirs(to.getParent())
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(where).toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(where), files.makeQualified(to), none)
    except Exception as problem:
        if "FileAlreadyExistsException" not in str(problem):
            raise
        return False
    return True


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file that appears whole under its name; False, and nothing written, if the name is taken."""
    folder, name = path.rsplit("/", 1)
    hidden = f"{folder}/_{name}-{uuid.uuid4().hex}"
    files, where = path_of(spark, hidden)
    files.mkdirs(where.getParent())
    stream = files.create(where, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    done = renamed(spark, hidden, path)
    if not done:
        files.delete(where, False)
    return done


def write_json_lines(rows: DataFrame, path: str) -> None:
    """The rows as JSON lines in a folder that appears whole under its name; an error if the name is taken."""
    spark, hidden = rows.sparkSession, f"{path.rstrip('/')}-_{uuid.uuid4().hex}"
    rows.write.option("ignoreNullFields", "false").json(hidden)
    if not renamed(spark, hidden, path):
        files, where = path_of(spark, hidden)
        files.delete(where, True)
        raise FileExistsError(path)
