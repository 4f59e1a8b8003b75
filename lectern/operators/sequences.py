"""Order-dependent grouped operators: windows, or a scan in order where no window expresses the rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import work_folder


def segments(rows: DataFrame, by: list[str], order: list, breaks, name: str = "segment") -> DataFrame:
    """Numbers the stretches that a break flag on the previous row ends (from 0)."""
    w = Window.partitionBy(*by).orderBy(*order)
    flag = F.coalesce(F.lag(breaks.cast("int")).over(w), F.lit(0))
    return rows.withColumn("_flag", flag).withColumn(name, F.sum("_flag").over(w)).drop("_flag")


def forward_fill(rows: DataFrame, by: list[str], order: list, column: str) -> DataFrame:
    """Nulls and blanks take the last value before them."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(F.nullif(F.trim(F.col(column)), F.lit("")), ignorenulls=True).over(w))


def islands(rows: DataFrame, by: list[str], start: str, end: str, order: list, name: str = "island") -> DataFrame:
    """Numbers groups of intervals that overlap or touch, by the running maximum of their ends."""
    w = Window.partitionBy(*by).orderBy(*order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_gap", F.when(F.col(start) <= reach, 0).otherwise(1)).withColumn(name, F.sum("_gap").over(w)).drop("_gap")


def scan(rows: DataFrame, by: list[str], order: list, schema: str, step: Callable[[pd.DataFrame, list], pd.DataFrame]) -> DataFrame:
    """Runs ``step`` over batches of each partition's rows, group after group in order; its second argument is a list of its own to keep state in.

    Groups share their task with others and no group is ever held whole, so many
    small groups cost no more than their rows and a large one no more memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: list = []
        for batch in batches:
            if len(batch):
                yield step(batch, state)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def lanes(events: DataFrame, by: list[str], start: str, end: str, key: str, cap: int = 5) -> DataFrame:
    """Greedy interval scheduling inside each group: the first free lane in (start, longer first, key) order, null past the cap."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in (*by, key)), "lane int"])

    def place(pdf: pd.DataFrame, state: list) -> pd.DataFrame:
        group, busy = state or ((), [])
        out = []
        for now, a, b in zip(pdf[by].itertuples(index=False, name=None), pdf[start], pdf[end], strict=True):
            if now != group:
                group, busy = now, []
            lane = next((i for i, until in enumerate(busy) if until < a), None)
            if lane is None and len(busy) < cap:
                busy.append(b)
                lane = len(busy) - 1
            elif lane is not None:
                busy[lane] = b
            out.append(lane)
        state[:] = (group, busy)
        return pdf[[*by, key]].assign(lane=pd.array(out, dtype="Int32"))

    return scan(events.select(*by, start, end, key), by, [F.asc(start), F.desc(end), F.asc(key)], schema, place)


def tree_paths(rows: DataFrame, key: str, parent: str, width: int = 9) -> DataFrame:
    """key, depth, path of every row that a root (null parent) reaches; paths sort as the tree's pre-order with its siblings by key.

    A path holds the keys from the root down, padded to ``width``.  One join a level:
    levels are written to the shared folder, so the plan does not grow with the depth.
    """
    spark, folder = rows.sparkSession, work_folder(rows.sparkSession, "tree")
    padded = F.lpad(F.col(key).cast("string"), width, "0")
    level, depth = rows.filter(F.col(parent).isNull()).select(key, F.lit(0).alias("depth"), padded.alias("path")), 0
    while True:
        level.write.parquet(f"{folder}/{depth}")
        above = spark.read.parquet(f"{folder}/{depth}")
        if not above.limit(1).count():
            return spark.read.parquet(f"{folder}/*")
        depth += 1
        above = above.select(F.col(key).alias(parent), F.col("path").alias("_above"))
        level = rows.join(above, parent).select(key, F.lit(depth).alias("depth"), F.concat("_above", F.lit("/"), padded).alias("path"))


def ordered_digest(rows: DataFrame, key: str, line: Column, width: int = 1024, levels: int = 3) -> DataFrame:
    """One row ``fingerprint``: SHA-256 over the rows' lines in the order of a whole-number key, by a tree.

    Lines of ``width`` neighbouring keys make a digest, as many neighbouring digests
    make the next one, so no task gets more than that (the last one gets a row for
    every width ** levels keys).  An empty table has the digest of an empty text.
    """
    at = rows.select(F.col(key).alias("at"), line.alias("line"))
    joined = lambda: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n"), 256)
    for _ in range(levels):
        at = at.groupBy(F.floor(F.col("at") / width).alias("up")).agg(joined().alias("line")).withColumnRenamed("up", "at")
    return at.agg(joined().alias("fingerprint"))


def diverse_sample(rows: DataFrame, labels: str, key: str, size: int) -> list:
    """``size`` keys (all, if fewer) that cover rare labels first and then evenly, in the order in which they are picked.

    A row scores 100 times the sum of 1 / frequency over its labels that no pick
    has yet, plus the sum of 1 / (1 + picks that have it) over all of them; ties go
    to the larger key.  Labels are a vocabulary: their frequencies, one row a
    label, come to the driver.  Each pick is one distributed aggregate of which one
    row comes back.
    """
    often = {r.label: r["count"] for r in rows.select(F.explode(labels).alias("label")).groupBy("label").count().collect()}
    covered, chosen = dict.fromkeys(often, 0), []
    as_map = lambda counts: F.create_map(*[F.lit(x) for pair in sorted(counts.items()) for x in pair]) if counts else F.create_map().cast("map<string,bigint>")
    frequency = as_map(often)
    while len(chosen) < size:
        times = as_map(covered)
        rare = F.aggregate(labels, F.lit(0.0), lambda s, x: s + F.when(times[x] == 0, 1.0 / frequency[x]).otherwise(0.0))
        even = F.aggregate(labels, F.lit(0.0), lambda s, x: s + 1.0 / (1 + times[x]))
        left = rows.filter(~F.col(key).isin(chosen)) if chosen else rows
        scored = left.select(F.struct(key, labels).alias("row"), F.struct((rare * 100 + even).alias("score"), F.col(key).alias("k")).alias("order"))
        best = scored.agg(F.max_by("row", "order").alias("row")).first().row
        if best is None:
            break
        chosen.append(best[key])
        for label in best[labels]:
            covered[label] += 1
    return chosen
