"""MinHash near-duplicate groups with verified links.

Many universal hash minima per document, banded into bucket keys.  A bucket's
members are held to its smallest by their signatures, and only what that leaves
apart is compared further, so what meets by chance makes no large clusters.
Clusters of alike signatures are compared in bounded blocks on full shingle sets,
and verified links are closed by large-star / small-star.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .session import cut, pieces, text_bytes
from .skew import hot_limit, join_hot
from .words import WordHasher, gram_hashes, multipliers, shingle_set

MINIMA = 180
#: Share of pairs at the threshold that may meet in no band.
MISSED = 1e-6
BLOCK_ROWS, BLOCK_BYTES = 512, 24_000_000
#: Documents of candidate clusters whose ids (16 bytes each) are broadcast to the texts; more of them are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows of numbers that one signature stands for where a side's size is held to what may be broadcast.
SIGNATURE_ROWS = 8
#: Share of equal minima below which a pair cannot reach the threshold: at 180
#: minima a similarity of 0.85 falls under 0.70 in about one pair of 10^7.
SLACK = 0.15

_A = (multipliers(MINIMA, 7) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (multipliers(MINIMA, 8) >> np.uint64(31)).astype(np.uint32)
_BAND_ODD = multipliers(MINIMA, 9)
_BAND_SALT = multipliers(MINIMA, 10)
_SET_ODD = multipliers(2, 11)


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows of each): the longest bands that miss a pair at the threshold in at most MISSED of cases (30 of 6 at 85, 36 of 5 at 80)."""
    return next((MINIMA // r, r) for r in range(8, 0, -1) if r == 1 or (1 - (percent / 100) ** r) ** (MINIMA // r) <= MISSED)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The minimum of every universal hash over one set of shingle hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        np.minimum(out, (_A[:, None] * x[None, k : k + 512] + _B[:, None]).min(axis=1), out=out)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key per band, different bands in different key spaces."""
    values = signature[: bands * rows].astype(np.uint64).reshape(bands, rows)
    return ((values + np.uint64(1)) * _BAND_ODD[:rows]).sum(axis=1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _BAND_SALT[:bands]


def _sets(hasher: WordHasher, texts: list[bytes | None], n: int) -> Iterator[np.ndarray]:
    for at, to, _data, _s, _e, hashes, first in hasher.documents(texts):
        grams = gram_hashes(hashes, n)
        for d in range(to - at):
            lo, hi = first[d], first[d + 1]
            yield shingle_set(hashes[lo:hi], grams[lo:hi], n)


def _hashes(s: np.ndarray) -> tuple[int | None, int | None]:
    """Two 64-bit sums that stand for a set (none for an empty one)."""
    if not len(s):
        return None, None
    return int((s * _SET_ODD[0]).sum(dtype=np.uint64).astype(np.int64)), int(((s ^ (s >> np.uint64(29))) * _SET_ODD[1]).sum(dtype=np.uint64).astype(np.int64))


def _describe(n: int, percent: int):
    bands = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in pieces(batches):
            count, keys, sigs, sums = [], [], [], []
            for s in _sets(hasher, text_bytes(batch), n):
                low = minima(s) if len(s) else None
                count.append(len(s))
                sums.append(_hashes(s))
                keys.append(band_keys(low, *bands).view(np.int64) if len(s) else None)
                sigs.append(low.astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count, pa.int64()), *(pa.array([x[k] for x in sums], pa.int64()) for k in (0, 1)), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands", "signature"],
            )

    return run


def _full_sets(n: int):
    """(cluster, id, set hash, shingles) of the texts of candidate clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in pieces(batches):
            sets = list(_sets(hasher, text_bytes(batch), n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("cluster"), batch.column("id"), batch.column("set_a"), pa.array([_hashes(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["cluster", "id", "set_a", "own", "shingles"],
            )

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _signatures(rows: Sequence[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


def _alike(percent: int) -> int:
    """Equal minima that a pair at the threshold has at least."""
    return int((percent / 100 - SLACK) * len(_A))


def _star_links(percent: int):
    """The pairs of a bucket's member and its smallest whose signatures are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            if batch.num_rows:
                same = (_signatures(batch.column("signature").to_pylist()) == _signatures(batch.column("other").to_pylist())).sum(axis=1)
                yield batch.select(["u", "v"]).filter(pa.array(same >= _alike(percent)))

    return run


def _compare(percent: int, loose_only: bool):
    """Links that join the rows of one task's group, as a forest: by signature, and by full sets where they are given.

    Rows of one ``part`` are joined already.  loose_only: a row that is not loose is compared with loose ones alone.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "loose"], kind="stable")
        ids, sig = rows["id"].to_numpy(), _signatures(rows["signature"])
        _, root = np.unique(rows["part"].to_numpy(), return_inverse=True)
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]] if "shingles" in rows else None
        least, out = _alike(percent), []
        for i in np.flatnonzero(rows["loose"].to_numpy()) if loose_only else range(1, len(rows)):
            end = len(rows) if loose_only else i
            same = (sig[:end] == sig[i]).sum(axis=1)
            near = np.flatnonzero((same >= least) & (root[:end] != root[i]))
            for j in near[np.argsort(-same[near], kind="stable")]:
                if root[j] != root[i] and (sets is None or linked(sets[i], sets[j], percent)):
                    out.append((int(ids[i]), int(ids[j])))
                    root[root == max(root[i], root[j])] = min(root[i], root[j])
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return run


def _rest_links(rows: DataFrame, group: str, percent: int, n_rows: int) -> DataFrame:
    """Links between the parts of each group: every row outside a group's largest part is compared with all of the group.

    rows: group, id, part, signature and perhaps shingles.  Both sides go in blocks of bounded rows and bytes.
    """
    size = F.length("shingles") if "shingles" in rows.columns else F.length("signature")
    parts = rows.groupBy(group, "part").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    largest = F.struct("n", (-F.col("part")).alias("p"), "part", "bytes")
    groups = parts.groupBy(group).agg(F.max(largest).alias("big"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).filter(F.col("n") > F.col("big.n"))
    blocks = lambda n, b: F.greatest(F.lit(1), F.ceil(n / BLOCK_ROWS), F.ceil(b / BLOCK_BYTES)).cast("int")
    groups = groups.select(group, F.col("big.part").alias("giant"), F.col("n").alias("rows"), blocks(F.col("n"), F.col("bytes")).alias("blocks"), blocks(F.col("n") - F.col("big.n"), F.col("bytes") - F.col("big.bytes")).alias("chunks"))
    placed = join_hot(rows, groups, [group], F.col("rows") > hot_limit(n_rows), n_rows // 2).withColumn("loose", F.col("part") != F.col("giant"))
    block, chunk = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    all_rows = placed.withColumn("loose", F.lit(False)).withColumn("b", block).withColumn("c", upto("chunks"))
    loose = placed.filter("loose").withColumn("c", chunk).withColumn("b", upto("blocks"))
    names = [group, "b", "c", "id", "part", "loose", *(c for c in ("signature", "shingles") if c in rows.columns)]
    return all_rows.select(*names).unionByName(loose.select(*names)).groupBy(group, "b", "c").applyInPandas(_compare(percent, True), "u long, v long")


def _candidate_clusters(classes: DataFrame, percent: int) -> DataFrame:
    """(node, component) of classes that alike signatures of a common bucket join."""
    keys = classes.select("rep", F.explode("bands").alias("band"))
    meets = keys.groupBy("band").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.count("*").alias("n")).filter("least < most")
    n_keys = banding(percent)[0] * classes.count()
    members = cut(join_hot(keys, meets, ["band"], F.col("n") > hot_limit(n_keys), n_keys // 2).select("band", "rep", "least", "n"))
    n_members = members.count()
    sigs = classes.select("rep", "signature")
    stars = cut(members.filter("rep <> least").select(F.col("rep").alias("u"), F.col("least").alias("v")).distinct())
    ends = stars.groupBy("v").agg(F.count("*").alias("n")).join(sigs.withColumnRenamed("rep", "v"), "v").withColumnRenamed("signature", "other")
    pairs = join_hot(stars.join(sigs.withColumnRenamed("rep", "u"), "u"), ends, ["v"], F.col("n") > hot_limit(n_members), SIGNATURE_ROWS * n_members)
    edges = cut(pairs.select("u", "v", "signature", "other").mapInArrow(_star_links(percent), "u long, v long"))
    # Of a bucket of two, the star has seen the only pair; one whose members are all tied to its smallest has nothing more to join.
    tied = edges.select(F.col("u").alias("rep"), F.col("v").alias("least"), F.lit(True).alias("tied"))
    several = members.filter("n > 2").join(tied, ["rep", "least"], "left")
    several = cut(several.select("band", F.col("rep").alias("id"), F.when(F.coalesce("tied", F.lit(False)), F.col("least")).otherwise(F.col("rep")).alias("part")))
    open_bands = several.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n")).filter("low < high")
    left = join_hot(several, open_bands, ["band"], F.col("n") > hot_limit(n_members), n_members // 3).select("band", "id", "part")
    left = cut(left.join(sigs.withColumnRenamed("rep", "id"), "id"))
    if not left.limit(1).count():
        return connected_components(edges)
    return connected_components(edges.unionByName(_rest_links(left, "band", percent, n_members)))


def _verified_links(texts: DataFrame, classes: DataFrame, clusters: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(u, v) of links on full sets that join what can be joined in each cluster."""
    wanted = classes.select("rep", "set_a").join(clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "rep")
    wanted = cut(wanted.select(F.col("rep").alias("doc_id"), "cluster", "set_a", F.col("rep").alias("id")))
    n_rows = wanted.count()
    found = texts.join(F.broadcast(wanted) if n_rows <= BROADCAST_ROWS else wanted, "doc_id").select("cluster", "id", "set_a", "text")
    full = found.mapInArrow(_full_sets(shingle), "cluster long, id long, set_a long, own long, shingles binary").filter("own = set_a")
    full = full.dropDuplicates(["id"]).drop("own", "set_a").join(classes.select(F.col("rep").alias("id"), "signature"), "id")
    full = cut(full)
    sizes = full.groupBy("cluster").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.length("shingles")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = join_hot(full, sizes, ["cluster"], F.col("n") > hot_limit(n_rows), n_rows // 2).withColumn("part", F.col("id")).withColumn("loose", F.lit(False))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # The first block's rows meet every block; in a cluster of one block that is every pair.
    tasks = placed.withColumn("b", F.explode(F.when(block == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))))
    names = ["cluster", "b", "id", "part", "loose", "signature", "shingles"]
    links = cut(tasks.select(*names).groupBy("cluster", "b").applyInPandas(_compare(percent, False), "u long, v long"))
    big = cut(sizes.filter("blocks > 1").select("cluster", "n"))
    n_big = big.count()
    if not n_big:
        return links
    large = join_hot(full, big, ["cluster"], F.col("n") > hot_limit(n_rows), n_big).drop("n")
    parts = connected_components(links.join(large.select(F.col("id").alias("u")), "u", "left_semi"))  # ids, one row each
    large = large.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    return links.unionByName(_rest_links(large, "cluster", percent, n_rows))


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    A row's set holds the distinct ``shingle``-word runs of its lower-cased (A-Z)
    text; fewer words make one shingle, none an empty set that links with
    nothing.  Rows are linked when 100 * intersection >= percent * union and
    component_id is the smallest doc_id reachable.  Null text counts as empty;
    rows with a null doc_id take no part and are not returned; repeated rows each
    get their row (of several texts under one doc_id that is the smallest of their
    equals, one links further); further columns of docs are ignored; no rows give no rows.

    Shingles are 64-bit hashes, and equal sets are known by a 128-bit hash of
    theirs, so a huge group of copies is one row in every later step.  Nothing
    emits a bucket's pairs: each member is held to its bucket's smallest, members
    that this leaves apart and rows of large clusters outside the largest part are
    compared with the rest in blocks, and only the links that join parts come out.
    """
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).filter("doc_id IS NOT NULL")
    described = cut(texts.mapInArrow(_describe(shingle, percent), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, signature binary"))
    sets = described.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands"), F.min("signature").alias("signature"), F.count("*").alias("n"))
    sets = cut(sets)
    # One class a doc_id takes part in links.
    classes = sets.groupBy("rep").agg(F.min(F.struct("set_a", "set_b", "bands", "signature")).alias("x")).select("rep", "x.*")
    classes = cut(classes)
    clusters = _candidate_clusters(classes, percent)
    groups = connected_components(_verified_links(texts, classes, clusters, percent, shingle))
    named = sets.select("set_a", "set_b", "rep", "n").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("set_a", "set_b", "n", F.coalesce("component", "rep").alias("component_id"))
    rows = described.select("doc_id", "n_shingles", "set_a", "set_b")
    some = join_hot(rows.filter("n_shingles > 0"), named, ["set_a", "set_b"], F.col("n") > hot_limit(described.count()), sets.count()).select("doc_id", "n_shingles", "component_id")
    out = some.unionByName(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
