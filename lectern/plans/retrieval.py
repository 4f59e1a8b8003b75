"""Search, re-ranking, grouping, chunking and build pipelines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vectors import cosine, dot
from ..operators.chunks import chunk_documents, chunk_problems
from ..operators.grouping import group_entities
from ..operators.ranking import bm25, hybrid_search, nearest, policy_rank, ranked, reciprocal_rank_fusion
from ..registry import query
from ..storage import cut

QUERY = ("heed", "thea", "license")
_TOKENS = r"list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')"
_BM25 = f"""(WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
tf AS (SELECT doc_id, len(w) AS size, q.term, len(list_filter(w, lambda x: x = q.term)) AS f FROM d, (VALUES ('heed'), ('thea'), ('license')) q(term)),
df AS (SELECT term, count_if(f > 0) AS df FROM tf GROUP BY term)
SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean))) AS score FROM tf JOIN df USING (term), s WHERE f > 0 GROUP BY doc_id)"""


@query("o_m1_bm25", f"SELECT doc_id, round(score, 6) AS score FROM {_BM25}")
def lexical(t):
    return bm25(t.documents, "doc_id", "text", QUERY).select("doc_id", F.round("score", 6).alias("score"))


_LIST = f"SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {_BM25} QUALIFY rank <= 50"
_DENSE = "SELECT vec_id AS doc_id, row_number() OVER (ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) DESC, vec_id) AS rank FROM embeddings e QUALIFY rank <= 50"
_RRF = f"SELECT doc_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM ({_LIST}) UNION ALL SELECT * FROM ({_DENSE})) GROUP BY doc_id"


def _vector(t, vec_id: int):
    """The query's vector as a frame of one row, or of none where the table lacks it (a search then finds nothing)."""
    return t.embeddings.filter(F.col("vec_id") == vec_id).select(F.col("embedding").alias("vector")).limit(1)


def _lists(t):
    lex = ranked(bm25(t.documents, "doc_id", "text", QUERY).orderBy(F.desc(F.round("score", 9)), "doc_id").limit(50), (F.desc(F.round("score", 9)), F.asc("doc_id")))
    near = nearest(t.embeddings, "embedding", _vector(t, 0), "vec_id", 50).withColumnRenamed("vec_id", "doc_id")
    return lex, ranked(near, (F.desc("similarity"), F.asc("doc_id")))


@query("o_m2_rank_fusion", f"SELECT doc_id, round(score, 6) AS score FROM ({_RRF})")
def fusion(t):
    return reciprocal_rank_fusion(_lists(t), "doc_id").select("doc_id", F.round("score", 6).alias("score"))


_AGES = "CASE WHEN doc_id % 3 = 0 THEN ['ELEMENTARY', 'ADULT'] WHEN doc_id % 3 = 1 THEN ['PRESCHOOL'] ELSE CAST(NULL AS VARCHAR[]) END"


def _hybrid_sql(method: str, age: str | None = None, grade: int | None = None) -> str:
    """The rows of hybrid_search over documents and vectors, with groups, ages and grade ranges by key."""
    own = {"BM25": "WHERE b.doc_id IS NOT NULL", "DENSE": "WHERE n.doc_id IS NOT NULL"}.get(method, "")
    fits = f"coalesce(list_contains(ages, '{age}'), FALSE)" if method == "HYBRID_TARGETED" and age else "FALSE"
    rrf = f"coalesce(1.0 / (60 + bm25_rank), 0) + coalesce(1.0 / (60 + dense_rank), 0) + CASE WHEN {fits} THEN 0.002 ELSE 0 END"
    score = {"BM25": "coalesce(bm25_score, 0)", "DENSE": "coalesce(similarity, -1)"}.get(method, rrf)
    keep = f"WHERE grade_min IS NULL OR (grade_min <= {grade} AND grade_max >= {grade})" if grade is not None else ""
    return f"""WITH b AS (SELECT doc_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {_BM25} QUALIFY rank <= 50),
n AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, doc_id) AS rank FROM (SELECT vec_id AS doc_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS similarity FROM embeddings) QUALIFY rank <= 50),
f AS (SELECT coalesce(b.doc_id, n.doc_id) AS doc_id, b.rank AS bm25_rank, n.rank AS dense_rank, b.score AS bm25_score, n.similarity FROM b FULL JOIN n ON b.doc_id = n.doc_id {own}),
r AS (SELECT doc_id, source AS group_id, {_AGES} AS ages, CASE WHEN doc_id % 4 > 0 THEN doc_id % 6 END AS grade_min, CASE WHEN doc_id % 4 > 0 THEN doc_id % 6 + 2 END AS grade_max FROM documents),
x AS (SELECT doc_id, group_id, bm25_rank, dense_rank, bm25_score, similarity, {f'{rrf}' if method.startswith('HYBRID') else 'CAST(NULL AS DOUBLE)'} AS rrf_score, CASE WHEN {fits} THEN ['TARGET_AGE_GROUP:+0.002'] ELSE CAST([] AS VARCHAR[]) END AS boosts, round({score}, 9) AS s FROM f JOIN r USING (doc_id) {keep})
SELECT CAST(row_number() OVER (ORDER BY s DESC, group_id, doc_id) AS INTEGER) AS rank, doc_id, group_id, bm25_rank, dense_rank, round(bm25_score, 6) AS bm25_score, round(similarity, 6) AS similarity, round(rrf_score, 6) AS rrf_score, boosts FROM x ORDER BY rank LIMIT 20"""


def _hybrid(t, method: str, age: str | None = None, grade: int | None = None, lists=None):
    d = F.col("doc_id")
    ages = F.when(d % 3 == 0, F.array(F.lit("ELEMENTARY"), F.lit("ADULT"))).when(d % 3 == 1, F.array(F.lit("PRESCHOOL")))
    ranged = lambda c: F.when(d % 4 > 0, c)
    records = t.documents.select("doc_id", F.col("source").alias("group_id"), ages.alias("ages"), ranged(d % 6).alias("grade_min"), ranged(d % 6 + 2).alias("grade_max"))
    lex, dense = lists or _lists(t)
    found = hybrid_search(lex, dense, records, "doc_id", method, 20, age, grade)
    return found.select("rank", "doc_id", "group_id", "bm25_rank", "dense_rank", *[F.round(c, 6).alias(c) for c in ("bm25_score", "similarity", "rrf_score")], "boosts")


@query("o_k6_bm25", _hybrid_sql("BM25", grade=3))
def hybrid_lexical(t):
    return _hybrid(t, "BM25", grade=3)


@query("o_k6_dense", _hybrid_sql("DENSE", grade=3))
def hybrid_dense(t):
    return _hybrid(t, "DENSE", grade=3)


@query("o_k6_hybrid", _hybrid_sql("HYBRID"))
def hybrid_plain(t):
    return _hybrid(t, "HYBRID")


@query("o_k6_hybrid_targeted", _hybrid_sql("HYBRID_TARGETED", "ELEMENTARY", 3))
def hybrid(t):
    return _hybrid(t, "HYBRID_TARGETED", "ELEMENTARY", 3)


# Candidates for re-ranking: vectors stand for chunks, labels for programs.
_CAND = "(SELECT vec_id AS c, label AS p, CASE vec_id % 3 WHEN 0 THEN 'CORE' WHEN 1 THEN 'SESSIONS' ELSE 'ATTACHMENT' END AS k, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings e)"


def _candidates(t):
    kind = F.when(F.col("vec_id") % 3 == 0, "CORE").when(F.col("vec_id") % 3 == 1, "SESSIONS").otherwise("ATTACHMENT")
    return t.embeddings.join(F.broadcast(_vector(t, 0)), how="cross").select(F.col("label").alias("program_id"), F.col("vec_id").alias("chunk_id"), kind.alias("chunk_type"), cosine(F.col("embedding"), F.col("vector")).alias("similarity"))


def _policy_sql(weights: tuple[float, float, float], second: float) -> str:
    w = f"CASE k WHEN 'CORE' THEN {weights[0]} WHEN 'SESSIONS' THEN {weights[1]} ELSE {weights[2]} END"
    rank = "CASE k WHEN 'CORE' THEN 0 WHEN 'SESSIONS' THEN 1 ELSE 2 END"
    return f"""WITH x AS (SELECT *, s * {w} AS adj, {rank} AS kp FROM {_CAND}), y AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY s DESC, kp, c) AS rep, row_number() OVER (PARTITION BY p ORDER BY adj DESC, kp, c) AS a FROM x),
z AS (SELECT p, max(CASE WHEN rep = 1 THEN c END) AS c, max(CASE WHEN rep = 1 THEN k END) AS k, max(CASE WHEN rep = 1 THEN kp END) AS kp, max(CASE WHEN rep = 1 THEN s END) AS s, max(CASE WHEN a = 1 THEN adj END) AS a1, max(CASE WHEN a = 2 THEN adj END) AS a2 FROM y GROUP BY p)
SELECT CAST(row_number() OVER (ORDER BY score DESC, s DESC, kp, p, c) AS INTEGER) AS rank, p AS program_id, c AS chunk_id, k AS chunk_type, round(s, 6) AS similarity, round(score, 6) AS score FROM (SELECT *, a1 + coalesce(least(a1, a2), 0) * {second} AS score FROM z)"""


def _policy(t, name):
    return policy_rank(_candidates(t), name).withColumn("similarity", F.round("similarity", 6)).withColumn("score", F.round("score", 6))


@query("o_m3_policy_baseline", _policy_sql((1.0, 1.0, 1.0), 0.0))
def policy_baseline(t):
    return _policy(t, "baseline")


@query("o_m3_policy_weighted", _policy_sql((1.0, 0.98, 0.95), 0.0))
def policy_weighted(t):
    return _policy(t, "weighted")


@query("o_k9_policy_aggregate", _policy_sql((1.0, 1.0, 1.0), 0.1))
def policy_aggregate(t):
    return _policy(t, "aggregate")


@query("o_k9_policy_combined", _policy_sql((1.0, 0.98, 0.95), 0.1))
def policy_combined(t):
    return _policy(t, "combined")


def _chunks(t):
    d = t.documents.withColumn("file", F.concat("source", F.lit(".txt"))).withColumn("core", F.concat_ws("\n", "lang", "source")).withColumn("sessions", F.when(F.col("doc_id") % 5 == 0, F.left("text", F.lit(5000))))
    return chunk_documents(d, "doc_id", "source", "lang", "core", "sessions", "file", "text")


@query("o_k1_chunker")
def chunker(t):
    return _chunks(t)


@query("o_k2_chunk_invariants", "SELECT doc_id, CAST(NULL AS VARCHAR[]) AS problems FROM documents WHERE false")
def chunk_invariants(t):
    return chunk_problems(_chunks(t), "doc_id")


@query("o_k4_entity_groups")
def entity_groups(t):
    p = t.part.withColumn("bucket", X.comparison_key(F.concat_ws(" ", "p_brand", "p_type")))
    blocked = t.part.filter("p_partkey % 40 = 0").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 40).alias("b"))
    return group_entities(p, "p_partkey", "bucket", "p_brand", blocked, "p_size")


_METHODS = (("BM25", "BM25", None, None), ("DENSE", "DENSE", None, None), ("HYBRID", "HYBRID", None, None), ("HYBRID_TARGETED", "HYBRID_TARGETED", "ELEMENTARY", None), ("BM25_GRADE", "BM25", None, 3), ("DENSE_GRADE", "DENSE", None, 3), ("HYBRID_GRADE", "HYBRID", None, 3))
_POOL = " UNION ALL ".join(f"SELECT '{name}' AS method, group_id, rank FROM ({_hybrid_sql(m, age, grade)}) WHERE rank <= 10" for name, m, age, grade in _METHODS)


@query("o_k10_pooling", f"SELECT group_id, list_sort(list(method || ':' || rank)) AS ranks, CAST(min(rank) AS INTEGER) AS best FROM (SELECT group_id, method, min(rank) AS rank FROM ({_POOL}) GROUP BY 1, 2) GROUP BY group_id")
def pooling(t):
    """Ten of each of seven methods, one row a group with its best rank under each method."""
    rows, lists = None, tuple(cut(x) for x in _lists(t))  # fifty rows each, for all seven methods
    for name, m, age, grade in _METHODS:
        one = _hybrid(t, m, age, grade, lists).filter("rank <= 10").select(F.lit(name).alias("method"), "group_id", "rank")
        rows = one if rows is None else rows.unionByName(one)
    each = rows.groupBy("group_id", "method").agg(F.min("rank").alias("rank"))
    return each.groupBy("group_id").agg(F.array_sort(F.collect_list(F.concat("method", F.lit(":"), F.col("rank").cast("string")))).alias("ranks"), F.min("rank").alias("best"))  # seven at most


@query("o_k11_profiles", r"SELECT label, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 2) AS percent FROM (SELECT unnest(CASE WHEN regexp_matches(text, 'License') OR regexp_matches(text, '@') THEN list_filter([CASE WHEN regexp_matches(text, 'License') THEN 'LICENSE' END, CASE WHEN regexp_matches(text, '@') THEN 'CONTACT' END], lambda x: x IS NOT NULL) ELSE ['UNKNOWN'] END) AS label FROM documents) GROUP BY label")
def profiles(t):
    labels = X.labels_of(F.col("text"), (("LICENSE", "License"), ("CONTACT", "@")), cap=3)
    n = t.documents.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(t.documents.agg(F.count("*").alias("all"))), how="cross").select("label", "n", F.round(100.0 * F.col("n") / F.col("all"), 2).alias("percent"))


@query("o_k12_outcomes", "SELECT source, a, b, CASE WHEN a IS NULL AND b IS NULL THEN 'indeterminate' WHEN b IS NULL OR a < b THEN 'ahead' WHEN a = b THEN 'same' ELSE 'behind' END AS outcome FROM (SELECT source, min(r1) FILTER (WHERE quality = 0) AS a, min(r2) FILTER (WHERE quality = 0) AS b FROM (SELECT d.source, l.quality, row_number() OVER (PARTITION BY d.source ORDER BY n_chars, doc_id) AS r1, row_number() OVER (PARTITION BY d.source ORDER BY n_chars DESC, doc_id) AS r2 FROM documents d JOIN labels l USING (doc_id)) GROUP BY source)")
def outcomes(t):
    w = Window.partitionBy("source")
    d = t.documents.join(t.labels, "doc_id")
    d = d.withColumn("r1", F.row_number().over(w.orderBy("n_chars", "doc_id"))).withColumn("r2", F.row_number().over(w.orderBy(F.desc("n_chars"), "doc_id")))
    hit = F.col("quality") == 0
    g = d.groupBy("source").agg(F.min(F.when(hit, F.col("r1"))).cast("long").alias("a"), F.min(F.when(hit, F.col("r2"))).cast("long").alias("b"))
    a, b = F.col("a"), F.col("b")
    return g.withColumn("outcome", F.when(a.isNull() & b.isNull(), "indeterminate").when(b.isNull() | (a < b), "ahead").when(a == b, "same").otherwise("behind"))


@query("o_k13_context", f"SELECT string_agg(concat('## ', doc_id, chr(10), left(text, 80)), chr(10) || chr(10) ORDER BY rank) AS context FROM ({_LIST}) JOIN documents USING (doc_id) WHERE rank <= 5")
def context(t):
    top = _lists(t)[0].filter("rank <= 5").join(t.documents, "doc_id").select("rank", F.concat(F.lit("## "), F.col("doc_id").cast("string"), F.lit("\n"), F.left("text", F.lit(80))).alias("block"))
    return top.agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("x")).select(F.array_join("x.block", "\n\n").alias("context"))


@query("o_k19_multi_entity", "SELECT 'part' AS kind, p_partkey AS id FROM part WHERE contains(lower(p_name), 'a1') UNION ALL SELECT 'customer', c_custkey FROM customer WHERE contains(lower(c_name), 'a1') OR c_custkey < 10 UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE contains(lower(s_name), '1')")
def multi_entity(t):
    p = t.part.filter(F.contains(F.lower("p_name"), F.lit("a1"))).select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"))
    c = t.customer.filter(F.contains(F.lower("c_name"), F.lit("a1")) | (F.col("c_custkey") < 10)).select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    return p.unionByName(c).unionByName(t.supplier.filter(F.contains(F.lower("s_name"), F.lit("1"))).select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id")))


@query("o_k20_pilot_search", "SELECT vec_id, label, round(d, 6) AS score FROM (SELECT vec_id, label, list_dot_product(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)) AS d FROM embeddings e WHERE label < 5) ORDER BY d DESC, vec_id LIMIT 10")
def pilot_search(t):
    s = t.embeddings.filter("label < 5").join(F.broadcast(_vector(t, 7)), how="cross").withColumn("d", dot(F.col("embedding"), F.col("vector")))
    return s.orderBy(F.desc("d"), "vec_id").limit(10).select("vec_id", "label", F.round("d", 6).alias("score"))

