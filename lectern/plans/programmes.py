"""Programme search queries: programmes and chunks stand on the vector table, with titles, targets and embedding records by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import programmes as P
from ..functions.vectors import cosine
from ..operators.board import FLOOR, LEAST_SCORE, board_search, chunk_search, current, embedding_action
from ..operators.ranking import policy_rank
from ..registry import query

TITLES = (
    "[특강] 그림책 놀이", "어린이 과학 실험실(10/15(토))", "영어 파닉스 교실", "성인 인문학 강연", "2024년 상반기 독서회", "보드게임 교실", "클레이 공예 만들기 체험",
    "크리스마스 인형극 공연", "글쓰기 논술반", "일본어 첫걸음", "미술과 그림책", "환경 탐구 실험 교실", "코딩 놀이터",
)
TARGETS = ("누구나", "초등 1~3학년", "초등 4-6학년", "초등학생", "유아 5~7세", "중학생", "성인", None, "", "지역주민 및 대학생", "1~2학년")
SUMMARIES = ("책을 읽고 이야기를 나누는 독서 모임", "화석을 발굴하고 관찰하는 실험", "종이접기와 만들기", "Main Sentence와 Quiz로 배우는 영어 수업", "동화구연과 샌드아트", "지역경제 아카데미", "", None, "감상문을 써보는 시간")
QUERIES = ("초등 저학년 과학 실험", "초등 4~6학년이 책을 읽고 토론하는 독서 모임", "초등학생 미술", "유아 그림책 놀이", "중학생 보드게임", "아이와 함께하는 만들기 체험", "직장인 인문학 강연", "지역주민 공연", "크리스마스 리스")


def _sql(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def _pick_sql(values, key: str) -> str:
    return f"([{', '.join(map(_sql, values))}])[CAST({key} % {len(values)} AS INTEGER) + 1]"


def _pick(values, key: str):
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


_PROGRAMMES = f"(SELECT vec_id, {_pick_sql(TITLES, 'vec_id')} || ' ' || CAST(vec_id % 4 + 1 AS VARCHAR) || '기' AS title, {_pick_sql(TARGETS, 'vec_id')} AS target, {_pick_sql(SUMMARIES, 'vec_id')} AS summary, embedding FROM embeddings)"
_VALUE = "replace(coalesce(target, ''), ' ', '')"
_AUDIENCES = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({_VALUE}, {_sql(p)}) THEN {_sql(n)} END" for n, p in P.DOCUMENT_AUDIENCES) + "], lambda x: x IS NOT NULL)"
_TEXT = "lower(concat_ws(' ', coalesce(title, ''), coalesce(summary, '')))"
_CONCEPTS = {
    group: "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains({_TEXT}, {_sql(w.lower())})" for w in words) + f" THEN {_sql(name)} END" for name, words in sorted(known.items())) + "], lambda x: x IS NOT NULL)"
    for group, known in P.CONCEPTS.items()
}
_SERIES = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '\(.*?\)|\[.*?\]', '', 'g'), '\d+\s*(?:기|차|회|타임|반)', '', 'g'), '\d{4}년|상반기|하반기', '', 'g'), '[^\p{L}\p{N}_]', '', 'g') || '|' || CASE WHEN len(audiences) = 0 THEN '-' ELSE array_to_string(list_sort(audiences), '') END"


def _programmes(t):
    title = F.concat(_pick(TITLES, "vec_id"), F.lit(" "), (F.pmod("vec_id", F.lit(4)) + 1).cast("string"), F.lit("기"))
    return t.embeddings.select("vec_id", title.alias("title"), _pick(TARGETS, "vec_id").alias("target"), _pick(SUMMARIES, "vec_id").alias("summary"), "embedding")


def _vector(t, vec_id: int = 0):
    """The query's vector as a frame of one row, or of none where the table lacks it."""
    return t.embeddings.filter(F.col("vec_id") == vec_id).select(F.col("embedding").alias("vector")).limit(1)


def _fit_sql(requested: str | None) -> tuple[str, str]:
    """(adjustment, reason) as SQL over a list column ``audiences``."""
    has = lambda *n: f"list_has_any(audiences, [{', '.join(map(_sql, n))}])"
    if requested is None:
        rules = [("TRUE", P.NO_REQUEST)]
    else:
        rules = [("len(audiences) = 0", P.NO_TARGET)]
        if requested == "general":
            rules += [(has("general"), P.GENERAL_MATCH), ("TRUE", P.GENERAL_MISS)]
        elif requested == "adult":
            rules += [(has("adult"), P.ADULT_MATCH), (has("general"), P.ADULT_GENERAL), ("TRUE", P.MISMATCH)]
        else:
            other = {"elementary_lower": "elementary_upper", "elementary_upper": "elementary_lower"}.get(requested)
            rules += [(f"{has(other)} AND NOT {has(requested)}", P.GRADE_MISMATCH)] if other else []
            rules += [(has(requested), P.EXACT_MATCH), (has(*P.COMPATIBLE[requested]), P.COMPATIBLE_MATCH), (has("general"), P.INCLUDED), ("TRUE", P.MISMATCH)]
    case = lambda k: "CASE " + " ".join(f"WHEN {c} THEN {r[0] if k == 0 else _sql(r[1])}" for c, r in rules) + " END"
    return f"CAST({case(0)} AS DOUBLE)", case(1)


def _match_sql(text: str) -> tuple[str, str, str, str, int]:
    """(adjustment, coverage, matched, missing, concepts asked) as SQL over list columns ``topics`` and ``activities``."""
    asked = P.concepts_of(text)
    n = sum(map(len, asked.values()))
    lists = {g: f"CAST([{', '.join(map(_sql, names))}] AS VARCHAR[])" for g, names in asked.items()}
    same = {g: f"list_filter({lists[g]}, lambda x: list_contains({g}, x))" for g in lists}
    miss = {g: f"list_filter({lists[g]}, lambda x: NOT list_contains({g}, x))" for g in lists}
    score = " + ".join(f"{P.CONCEPT_WEIGHT[g]} * (len({same[g]}) - len({miss[g]}))" for g in lists)
    both = lambda d: f"list_sort(list_concat({d['topics']}, {d['activities']}))"
    return f"round(CAST({score} AS DOUBLE), 8)", f"len({both(same)}) / {n}.0", both(same), both(miss), n


@query("o_x15_search_series", f"SELECT vec_id, {_SERIES} AS key FROM (SELECT *, {_AUDIENCES} AS audiences FROM {_PROGRAMMES})")
def search_series(t):
    return _programmes(t).select("vec_id", P.series_key(F.col("title"), P.document_audiences(F.col("target"))).alias("key"))


@query("o_x29_concepts", f"SELECT vec_id, {_CONCEPTS['topics']} AS topics, {_CONCEPTS['activities']} AS activities FROM {_PROGRAMMES}")
def concepts(t):
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    return _programmes(t).select("vec_id", P.concepts(text, "topics").alias("topics"), P.concepts(text, "activities").alias("activities"))


@query("o_x30_query_audience", f"SELECT n_nationkey, asked, CASE {' '.join(f'WHEN regexp_matches(asked, {_sql(p)}) THEN {_sql(n)}' for n, p in P.QUERY_AUDIENCES)} END AS audience FROM (SELECT n_nationkey, {_pick_sql(QUERIES, 'n_nationkey')} AS asked FROM nation)")
def query_audience(t):
    return t.nation.select("n_nationkey", _pick(QUERIES, "n_nationkey").alias("asked")).withColumn("audience", P.query_audience(F.col("asked")))


@query("o_x30_first_audience", f"SELECT vec_id, {_AUDIENCES} AS audiences FROM {_PROGRAMMES}")
def document_audiences(t):
    return _programmes(t).select("vec_id", P.document_audiences(F.col("target")).alias("audiences"))


_M4 = _match_sql(QUERIES[1])


@query("o_m4_concept_adjustment", f"SELECT vec_id, {_M4[0]} AS adjustment, {_M4[1]} AS coverage, {_M4[2]} AS matched, {_M4[3]} AS missing FROM (SELECT vec_id, {_CONCEPTS['topics']} AS topics, {_CONCEPTS['activities']} AS activities FROM {_PROGRAMMES})")
def concept_adjustment(t):
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    x = P.concept_adjustment(P.concepts_of(QUERIES[1]), {g: P.concepts(text, g) for g in P.CONCEPTS})
    return _programmes(t).select("vec_id", x.alias("x")).select("vec_id", "x.adjustment", "x.coverage", "x.matched", "x.missing")


_REQUESTS = (None, "general", "adult", *P.COMPATIBLE)
_M5 = " UNION ALL ".join(f"SELECT vec_id, {_sql(r)} AS requested, {_fit_sql(r)[0]} AS adjustment, {_fit_sql(r)[1]} AS reason FROM a" for r in _REQUESTS)


@query("o_m5_audience_adjustment", f"WITH a AS (SELECT vec_id, {_AUDIENCES} AS audiences FROM {_PROGRAMMES}) {_M5}")
def audience_adjustment(t):
    a = _programmes(t).select("vec_id", P.document_audiences(F.col("target")).alias("audiences"))
    each = F.array(*[F.struct(F.lit(r).cast("string").alias("requested"), P.audience_adjustment(r, F.col("audiences")).alias("x")) for r in _REQUESTS])
    return a.select("vec_id", F.explode(each).alias("e")).select("vec_id", "e.requested", "e.x.adjustment", "e.x.reason")


def _board_sql(text: str, audience: str | None, limit: int) -> str:
    """The rows of board_search for one query."""
    fit, match = _fit_sql(P.query_audience_of(text)), _match_sql(text)
    keep = f"WHERE list_has_any(audiences, [{', '.join(map(_sql, (*P.AUDIENCE_FILTERS[audience], 'general')))}])" if audience else ""
    covered = f"AND coverage >= {1.0 if match[4] <= 2 else 0.66}" if match[4] else ""
    return f"""WITH p AS (SELECT *, {_AUDIENCES} AS audiences, {_CONCEPTS['topics']} AS topics, {_CONCEPTS['activities']} AS activities FROM {_PROGRAMMES}),
s AS (SELECT vec_id, {_SERIES} AS series, round(list_dot_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 8) AS similarity, {fit[0]} AS fit, {fit[1]} AS reason, {match[0]} AS match, {match[1]} AS coverage, {match[2]} AS matched, {match[3]} AS missing FROM p {keep}),
e AS (SELECT *, round(round(similarity + fit, 8) + match, 8) AS score FROM s WHERE round(round(similarity + fit, 8) + match, 8) >= {LEAST_SCORE} AND fit > -0.25 {covered}),
f AS (SELECT * FROM e WHERE similarity >= (SELECT max(similarity) FROM e) * {FLOOR}),
g AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY score DESC, similarity DESC, vec_id) AS r, count(*) OVER (PARTITION BY series) AS n FROM f)
SELECT CAST(row_number() OVER (ORDER BY score DESC, similarity DESC, vec_id) AS INTEGER) AS rank, vec_id AS source_id, series, n AS series_count, round(similarity, 6) AS similarity, round(score, 6) AS ranking_score, fit AS audience_adjustment, reason AS audience_match, match AS concept_adjustment, round(coverage, 4) AS concept_coverage, matched, missing FROM g WHERE r = 1 ORDER BY rank LIMIT {limit}"""


def _board(t, text: str, audience: str | None):
    found = board_search(_programmes(t).withColumnRenamed("vec_id", "source_id"), _vector(t), text, 50, audience)
    for name, digits in (("similarity", 6), ("ranking_score", 6), ("concept_coverage", 4)):
        found = found.withColumn(name, F.round(name, digits))
    return found


@query("o_k7_board_search", _board_sql(QUERIES[0], "elementary-lower", 50))
def board(t):
    return _board(t, QUERIES[0], "elementary-lower")


@query("o_k7_board_search_open", _board_sql(QUERIES[1], None, 50))
def board_open(t):
    return _board(t, QUERIES[1], None)


EVALUATION = ((QUERIES[0], "elementary-lower"), (QUERIES[1], "elementary-upper"))


def _evaluation_sql() -> str:
    parts = []
    for text, audience in EVALUATION:
        keep = f"[{', '.join(map(_sql, (*P.AUDIENCE_FILTERS[audience], 'general')))}]"
        for name, chosen in (("filtered", audience), ("open", None)):
            ok = f"(SELECT list_has_any({_AUDIENCES}, {keep}) FROM {_PROGRAMMES} x WHERE x.vec_id = source_id)"
            parts.append(f"SELECT {_sql(text)} AS asked, {_sql(name)} AS run, count(*) AS results, coalesce(count_if({ok}), 0) AS fitting, round(coalesce(avg(concept_coverage), 0.0), 4) AS coverage FROM ({_board_sql(text, chosen, 5)})")
    return " UNION ALL ".join(parts)


@query("o_a33_audience_precision", _evaluation_sql())
def audience_precision(t):
    """For each query of a set: its best five results with and without the audience filter, how many fit the audience, their mean concept coverage."""
    out = None
    for text, audience in EVALUATION:
        keep = F.array(*map(F.lit, (*P.AUDIENCE_FILTERS[audience], "general")))
        fitting = _programmes(t).select(F.col("vec_id").alias("source_id"), F.arrays_overlap(P.document_audiences(F.col("target")), keep).alias("ok"))
        for name, chosen in (("filtered", audience), ("open", None)):
            top = board_search(_programmes(t).withColumnRenamed("vec_id", "source_id"), _vector(t), text, 5, chosen)
            one = fitting.join(F.broadcast(top.select("source_id", F.round("concept_coverage", 4).alias("c"))), "source_id")  # five rows at most
            one = one.agg(F.count("*").alias("results"), F.count_if("ok").alias("fitting"), F.round(F.coalesce(F.avg("c"), F.lit(0.0)), 4).alias("coverage"))
            one = one.select(F.lit(text).alias("asked"), F.lit(name).alias("run"), "results", "fitting", "coverage")
            out = one if out is None else out.unionByName(one)
    return out


# Embedding records of chunks: what the embedding was made with, by key.
METADATA = {"provider": "local", "model": "model-a", "revision": "r2", "version": "v1", "dimension": 64}
_STATUS = ("COMPLETED", "COMPLETED", "PROCESSING", "FAILED", "COMPLETED", "COMPLETED", "COMPLETED")
_KINDS = ("CORE", "SESSIONS", "ATTACHMENT")
_RECORDS = f"""(SELECT vec_id AS chunk_id, label AS program_id, embedding, {_pick_sql(_KINDS, 'vec_id')} AS chunk_type, {_pick_sql(TARGETS, 'vec_id')} AS target, {_pick_sql(_STATUS, 'vec_id')} AS status,
CASE WHEN vec_id % 11 = 0 THEN 'remote' ELSE 'local' END AS provider, CASE WHEN vec_id % 13 = 0 THEN 'model-b' ELSE 'model-a' END AS model, CASE WHEN vec_id % 17 = 0 THEN 'r1' ELSE 'r2' END AS revision,
CASE WHEN vec_id % 19 = 0 THEN 'v0' ELSE 'v1' END AS version, CASE WHEN vec_id % 23 = 0 THEN 32 ELSE len(embedding) END AS dimension, md5(CAST(vec_id AS VARCHAR) || CASE WHEN vec_id % 29 = 0 THEN 'old' ELSE '' END) AS embedded_hash,
TIMESTAMP '2024-03-01 12:00:00' - CAST(vec_id % 60 AS INTEGER) * INTERVAL 1 MINUTE AS attempted_at FROM embeddings)"""
_CURRENT = "status = 'COMPLETED' AND embedded_hash = content_hash AND " + " AND ".join(f"{k} = {_sql(v) if isinstance(v, str) else v}" for k, v in METADATA.items())


def _records(t):
    v = F.col("vec_id")
    other = lambda n, a, b: F.when(v % n == 0, F.lit(a)).otherwise(F.lit(b))
    at = F.expr("TIMESTAMP '2024-03-01 12:00:00' - make_interval(0, 0, 0, 0, 0, CAST(pmod(vec_id, 60) AS INT), 0)")
    return t.embeddings.select(
        v.alias("chunk_id"), F.col("label").alias("program_id"), "embedding", _pick(_KINDS, "vec_id").alias("chunk_type"), _pick(TARGETS, "vec_id").alias("target"), _pick(_STATUS, "vec_id").alias("status"),
        other(11, "remote", "local").alias("provider"), other(13, "model-b", "model-a").alias("model"), other(17, "r1", "r2").alias("revision"), other(19, "v0", "v1").alias("version"),
        F.when(v % 23 == 0, 32).otherwise(F.size("embedding")).alias("dimension"), F.md5(F.concat(v.cast("string"), other(29, "old", ""))).alias("embedded_hash"), at.alias("attempted_at"),
    )


_CHUNKS = f"(SELECT r.*, md5(CAST(chunk_id AS VARCHAR)) AS content_hash FROM {_RECORDS} r)"


def _chunks(t):
    return _records(t).withColumn("content_hash", F.md5(F.col("chunk_id").cast("string")))


@query("o_f8_version_guard", f"SELECT chunk_id FROM {_CHUNKS} WHERE {_CURRENT}")
def version_guard(t):
    return _chunks(t).filter(current(METADATA)).select("chunk_id")


def _chunk_sql(limit: int, more: str) -> str:
    order = "s DESC, CASE chunk_type WHEN 'CORE' THEN 0 WHEN 'SESSIONS' THEN 1 ELSE 2 END, chunk_id"
    return f"""WITH n AS (SELECT *, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS s FROM {_CHUNKS} WHERE {_CURRENT} {more}),
m AS (SELECT * FROM n WHERE s >= -0.5 ORDER BY s DESC, chunk_id LIMIT {max(5 * limit, 20)}), d AS (SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY {order}) AS r FROM m)
SELECT CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank, program_id, chunk_id, chunk_type, round(s, 6) AS similarity, (SELECT count(*) FROM m) AS candidates, (SELECT count(DISTINCT program_id) FROM m) AS programs FROM d WHERE r = 1 ORDER BY rank LIMIT {limit}"""


@query("o_k8_chunk_search", _chunk_sql(5, ""))
def chunks(t):
    return chunk_search(_chunks(t), _vector(t), METADATA, 5, -0.5).withColumn("similarity", F.round("similarity", 6))


@query("o_k8_chunk_search_filtered", _chunk_sql(10, "AND chunk_type = 'CORE' AND contains(lower(target), '초등')"))
def chunks_filtered(t):
    return chunk_search(_chunks(t), _vector(t), METADATA, 10, -0.5, "CORE", "초등").withColumn("similarity", F.round("similarity", 6))


@query("o_k16_planner", rf"""SELECT action, count(*) AS n FROM (SELECT CASE WHEN trim(regexp_replace(coalesce(d.text, ''), '\s+', ' ', 'g')) = '' THEN 'skipped_empty'
WHEN status = 'PROCESSING' AND attempted_at >= TIMESTAMP '2024-03-01 12:00:00' - INTERVAL 30 MINUTES THEN 'skipped_recent_processing' WHEN {_CURRENT.replace('content_hash', 'md5(CAST(doc_id AS VARCHAR))')} THEN 'unchanged'
WHEN chunk_id IS NOT NULL THEN 'would_update' ELSE 'would_create' END AS action FROM documents d LEFT JOIN {_RECORDS} r ON r.chunk_id = d.doc_id) GROUP BY 1""")
def planner(t):
    held = _records(t).drop("embedding", "target").withColumn("exists", F.lit(True))
    j = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.md5(F.col("doc_id").cast("string")).alias("content_hash")).join(held, "chunk_id", "left")
    return j.groupBy(embedding_action(METADATA, F.expr("TIMESTAMP '2024-03-01 12:00:00'")).alias("action")).agg(F.count("*").alias("n"))


# Label bonuses: what is asked for, and each program's labels by key (UNKNOWN counts as none).
REQUESTED = {"ages": ("ELEMENTARY", "PRESCHOOL"), "categories": ("ART",), "participation": ("FAMILY", "UNKNOWN"), "operation": ("ONE_DAY",)}
_LABELS = {
    "ages": (("ELEMENTARY",), ("ADULT",), ("UNKNOWN",), ("PRESCHOOL", "ADULT")),
    "categories": (("ART", "READING"), ("SCIENCE",), ("UNKNOWN",)),
    "participation": (("FAMILY",), ("INDIVIDUAL",), (), ("UNKNOWN", "FAMILY"), ("INDIVIDUAL",)),
    "operation": (("ONE_DAY",), ("SERIES",)),
}


def _labels_sql(axis: str, key: str) -> str:
    lists = ", ".join(f"CAST([{', '.join(map(_sql, v))}] AS VARCHAR[])" for v in _LABELS[axis])
    return f"([{lists}])[CAST({key} % {len(_LABELS[axis])} AS INTEGER) + 1]"


def _candidates(t):
    labels = {axis: F.element_at(F.array(*[F.array(*map(F.lit, v)).cast("array<string>") for v in lists]), (F.pmod("program_id", F.lit(len(lists))) + 1).cast("int")) for axis, lists in _LABELS.items()}
    near = t.embeddings.join(F.broadcast(_vector(t)), how="cross").select(F.col("label").alias("program_id"), F.col("vec_id").alias("chunk_id"), _pick(_KINDS, "vec_id").alias("chunk_type"), cosine(F.col("embedding"), F.col("vector")).alias("similarity"))
    return near.select("*", *[labels[a].alias(a) for a in _LABELS])


def _policy_sql(weights, second: float, bonuses, hard: bool) -> str:
    w = f"CASE k WHEN 'CORE' THEN {weights[0]} WHEN 'SESSIONS' THEN {weights[1]} ELSE {weights[2]} END"
    kp = "CASE k WHEN 'CORE' THEN 0 WHEN 'SESSIONS' THEN 1 ELSE 2 END"
    same, keep = [], []
    for (axis, asked), bonus in zip(REQUESTED.items(), bonuses, strict=True):
        known = f"list_filter({axis}, lambda x: x <> 'UNKNOWN')"
        hit = f"list_has_any({known}, [{', '.join(_sql(a) for a in asked if a != 'UNKNOWN')}])"
        same.append(f"CASE WHEN {hit} THEN {bonus} ELSE 0 END")
        keep.append(f"(len({known}) = 0 OR {hit})")
    where = f"WHERE {' AND '.join(keep)}" if hard else ""
    return f"""WITH x AS (SELECT vec_id AS c, label AS p, {_pick_sql(_KINDS, 'vec_id')} AS k, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings),
y AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY s DESC, {kp}, c) AS r, row_number() OVER (PARTITION BY p ORDER BY s * {w} DESC) AS a FROM x),
z AS (SELECT p, max(CASE WHEN r = 1 THEN c END) AS c, max(CASE WHEN r = 1 THEN k END) AS k, max(s) AS s, max(s * {w}) AS a1, max(CASE WHEN a = 2 THEN s * {w} END) AS a2 FROM y GROUP BY p),
l AS (SELECT *, {', '.join(f'{_labels_sql(axis, "p")} AS {axis}' for axis in _LABELS)} FROM z),
b AS (SELECT *, a1 + coalesce(least(a1, a2), 0) * {second} + {' + '.join(same)} AS score FROM l {where})
SELECT CAST(row_number() OVER (ORDER BY round(score, 9) DESC, round(s, 9) DESC, {kp}, p, c) AS INTEGER) AS rank, p AS program_id, c AS chunk_id, k AS chunk_type, round(s, 6) AS similarity, round(score, 6) AS score FROM b"""


def _policy(t, name: str):
    return policy_rank(_candidates(t), name, REQUESTED).withColumn("similarity", F.round("similarity", 6)).withColumn("score", F.round("score", 6))


@query("o_m3_policy_metadata", _policy_sql((1.0, 1.0, 1.0), 0.0, (0.04, 0.04, 0.03, 0.02), False))
def policy_metadata(t):
    return _policy(t, "metadata")


@query("o_m3_policy_hard_filter", _policy_sql((1.0, 0.98, 0.95), 0.1, (0.04, 0.04, 0.03, 0.02), True))
def policy_hard_filter(t):
    return _policy(t, "combined")
