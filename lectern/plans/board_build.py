"""The programme board from crawled posts: dictionary, body lines, fees, series, typed rows, over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.attachment_merge import merge_attachments
from ..operators.normalise import dictionary_lookup, fees, normalise_programmes, series_of, structure_bodies
from ..registry import query

# The dictionary: every nation by its name anywhere in a tag, or by its short name alone between slashes; the longer names first.
_ENTRIES = "SELECT 24 - n_nationkey AS ord, n_name AS canonical, lower(n_name) AS inside, concat('n', n_nationkey) AS short FROM nation"
_TAG = "CASE c_mktsegment WHEN 'BUILDING' THEN concat(n_name, ' (사립)') WHEN 'AUTOMOBILE' THEN concat('비대면 - x/N', c_nationkey) WHEN 'MACHINERY' THEN 'No ne' WHEN 'FURNITURE' THEN concat('사립 ', n_name, 'y/z') ELSE concat('xN', c_nationkey) END"
_PLAIN_TAG = "CASE c_mktsegment WHEN 'BUILDING' THEN lower(n_name) WHEN 'AUTOMOBILE' THEN concat('x/n', c_nationkey) WHEN 'MACHINERY' THEN 'none' WHEN 'FURNITURE' THEN concat(lower(n_name), 'y/z') ELSE concat('xn', c_nationkey) END"


def _entries(t) -> DataFrame:
    return t.nation.select((24 - F.col("n_nationkey")).alias("ord"), F.col("n_name").alias("canonical"), F.array("n_name").alias("contains"), F.array(F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))).alias("equals"))


def _tagged(t) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("tag", F.expr(_TAG))


@query("o_x19_dictionary", f"""WITH e AS ({_ENTRIES}), tags AS (SELECT c_custkey, {_PLAIN_TAG} AS tag FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, min_by(canonical, ord) AS library, min(ord) IS NULL AND any_value(tag) = 'none' AS known_negative
FROM tags LEFT JOIN e ON contains(tag, inside) OR list_contains(string_split(tag, '/'), short) GROUP BY 1""")
def dictionary(t):
    tags = _tagged(t).select("c_custkey", "tag")
    return tags.join(dictionary_lookup(tags, "tag", _entries(t), ["none"]), "tag").select("c_custkey", F.col("canonical").alias("library"), "known_negative")


@query("o_x14_series_key", "SELECT p_partkey, concat(p_brand, '::', replace(p_name, ' ', ''), 'class') AS series_key, concat(p_size, '/', 1 + p_size % 28, '(토)', CASE WHEN p_size > 25 THEN concat(' (', 1 + p_size % 9, '차)') ELSE '' END) AS occurrence FROM part")
def series_key(t):
    n = lambda c: c.cast("string")
    s = F.col("p_size")
    title = F.concat(F.lit("[a][b] "), "p_name", F.lit(" "), n(s), F.lit(" / "), n(1 + s % 28), F.lit("(토)"), F.when(s > 25, F.concat(F.lit(" ("), n(1 + s % 9), F.lit("차)"))).otherwise(""), F.lit("<class>"))
    x = series_of(title, F.col("p_brand"))
    return t.part.select("p_partkey", x["series_key"].alias("series_key"), F.replace(x["occurrence"], F.lit(" / "), F.lit("/")).alias("occurrence"))


@query("o_x25_fees", """SELECT p_partkey, p_size < 10 AS is_free,
  concat(CASE WHEN p_size < 10 THEN '수 강 료 : 무료' WHEN p_size > 40 THEN '수강료 1,000원' ELSE '교육비는 문의' END, chr(10), '재료비: ', p_size, ',000원', CASE WHEN p_size > 30 THEN concat(chr(10), '재료비 약 ', p_size // 2 * 2, ',000원') ELSE '' END) AS fee_text,
  CASE WHEN p_size <= 30 OR p_size % 2 = 0 THEN CAST(1000 * p_size AS BIGINT) END AS material_fee, p_size > 30 AND p_size % 2 = 1 AS ambiguous FROM part""")
def fee_lines(t):
    s = F.col("p_size")
    first = F.when(s < 10, " 수 강 료 : 무료").when(s > 40, "수강료 1,000원").otherwise("교육비는 문의")
    even = (F.floor(s / 2) * 2).cast("string")
    detail = F.concat(F.lit("about this\n"), first, F.lit("\n재료비: "), s.cast("string"), F.lit(",000원 \n"), F.when(s > 30, F.concat(F.lit("재료비 약 "), even, F.lit(",000원\n"))).otherwise(""), F.lit("bye"))
    return t.part.select("p_partkey", fees(detail).alias("x")).select("p_partkey", "x.*")


_TOPICS = (("cost", ("재료비는", "환불")), ("contact", ("문의", "전화")))


def _labels(t) -> DataFrame:
    rows = [("장소", "location", "operation"), ("준비물", "materials", "content"), ("대상", "targetAudience", None), ("비고", None, None)]
    return t.spark.createDataFrame(rows, "label string, field string, section string")


# Each part a post; the lines, and what must become of each, stand side by side.
@query("o_x22_sections", """WITH p AS (SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part)
SELECT p_partkey, 'intro' AS kind, NULL AS section, 0 AS position, NULL AS label, 'about this' AS value FROM p
UNION ALL SELECT p_partkey, 'intro', NULL, 1, NULL, concat('size: ', p_size) FROM p
UNION ALL SELECT p_partkey, 'intro', NULL, 2, NULL, '비고 : none' FROM p
UNION ALL SELECT p_partkey, 'intro', NULL, 3, NULL, '(after that)' FROM p
UNION ALL SELECT p_partkey, 'intro', NULL, 4, NULL, '재료비는 있다면' FROM p
UNION ALL SELECT p_partkey, 'unmapped', NULL, 0, 'size', NULL FROM p
UNION ALL SELECT p_partkey, 'item', 'operation', 0, '장소', concat(p_brand, ' (second floor) - by the door') FROM p
UNION ALL SELECT p_partkey, 'item', 'content', 1, '준 비 물', p_type FROM p
UNION ALL SELECT p_partkey, 'notice', 'cost', 0, NULL, '- 재료비는 현장에서 납부합니다.' FROM p
UNION ALL SELECT p_partkey, 'notice', 'contact', 1, NULL, '문의는 전화로 바랍니다' FROM p
UNION ALL SELECT p_partkey, 'notice', 'etc', 2, NULL, concat('free words ', p_size) FROM p""")
def body_sections(t):
    lines = [
        F.lit("about this"), F.concat(F.lit("▢ "), "p_name", F.lit(" !")), F.lit(""), F.concat(F.lit(" 장소 : "), "p_brand"), F.lit("(second floor)"), F.concat(F.lit("cell "), F.col("p_size").cast("string")), F.lit("- by the door"),
        F.concat(F.lit("1. 준 비 물: "), "p_type"), F.lit("- 재료비는 현장에서 납부합니다."), F.concat(F.lit("size: "), F.col("p_size").cast("string")), F.lit("비고 : none"), F.lit("대상 : all"), F.lit("(after that)"), F.lit("재료비는 있다면"),
    ]
    notices = F.concat(F.lit("문의는 전화로 바랍니다\r\nfree words "), F.col("p_size").cast("string"), F.lit("\n문의는  전화로 바랍니다"))
    # Parts lie in few files; the bodies made of them are many times as long.
    posts = t.part.repartition("p_partkey").select("p_partkey", F.array_join(F.array(*lines), "\n").alias("body"), notices.alias("notices"), F.array("p_name", F.lit(None).cast("string")).alias("basics"), F.concat(F.lit("a cell "), F.col("p_size").cast("string"), F.lit(" b")).alias("table_text"))
    return structure_bodies(posts, "p_partkey", _labels(t), _TOPICS, ["targetAudience"])


# Each customer a post: the segment makes its title, the balance what its fields hold.
_BOARD = f"""raw AS (SELECT *, {_PLAIN_TAG} AS tag, c_mktsegment AS seg, c_acctbal AS b, CAST(c_nationkey AS BIGINT) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey), e AS ({_ENTRIES}),
hits AS (SELECT c_custkey, min_by(canonical, ord) AS by_tag FROM raw JOIN e ON seg NOT IN ('HOUSEHOLD') AND (contains(tag, inside) OR list_contains(string_split(tag, '/'), short)) GROUP BY 1),
named AS (SELECT raw.*, by_tag, CASE WHEN by_tag IS NULL AND seg = 'HOUSEHOLD' AND b > 0 THEN n_name END AS by_body, coalesce(by_tag, CASE WHEN seg = 'HOUSEHOLD' AND b > 0 THEN n_name END) AS library FROM raw LEFT JOIN hits USING (c_custkey)),
read AS (
  SELECT *, CASE WHEN b > 8000 THEN '테스트 1' WHEN seg = 'HOUSEHOLD' THEN concat('Talk ', c_custkey, ' x') ELSE concat('Reading ', c_custkey, ' x 4/11(토)') END AS plain_title, seg = 'MACHINERY' AND b <= 8000 AS negative,
    CASE WHEN b > 1000 THEN '일반인' END AS grp, CASE WHEN b > 2000 THEN '성인 모두' END AS detail_of, CASE WHEN b > 7000 THEN NULL WHEN b > 6000 AND b <= 6500 THEN k + 1 ELSE k END AS capacity,
    CASE WHEN b > 6500 THEN [k + 1, k + 2] WHEN b > 6000 THEN [k + 1] ELSE CAST([] AS BIGINT[]) END AS candidates, CASE WHEN b >= -500 THEN '화 10:00' END AS schedule, b > 3000 AS has_detail, b > 4000 AS fee_line
  FROM named
), final AS (
  SELECT *, CASE WHEN b > 8000 THEN NULL ELSE library END AS lib, CASE WHEN b > 8000 THEN 'TEST_TITLE' WHEN schedule IS NULL THEN 'SCHEDULE_WITHOUT_ANY_DIGIT' END AS reason FROM read
), warned AS (
  SELECT *, list_filter([CASE WHEN lib IS NULL AND NOT negative THEN 'LIBRARY_NAME_UNRESOLVED' END, CASE WHEN grp IS NULL OR detail_of IS NULL OR capacity IS NULL OR schedule IS NULL THEN 'INVALID_CORE_FIELD' END,
    CASE WHEN b > 6000 AND b <= 6500 THEN 'CAPACITY_OVERRIDDEN_BY_DETAIL' END, CASE WHEN b > 6500 THEN 'CAPACITY_DETAIL_AMBIGUOUS' END, CASE WHEN NOT has_detail THEN 'DESCRIPTION_MISSING' END, CASE WHEN fee_line AND b <= 5000 THEN 'TUITION_STATUS_UNKNOWN' END], lambda w: w IS NOT NULL) AS warnings FROM final
), board AS (
  SELECT c_custkey AS source_id, plain_title AS title, lib AS library_name, CASE WHEN lib IS NULL THEN NULL WHEN by_tag IS NOT NULL THEN 'title_tag' ELSE 'body_location' END AS library_source, negative AS known_non_library, grp AS target_group, detail_of AS target_detail,
    'Kim' AS instructor, capacity, candidates AS capacity_candidates, '2026-01-01' AS program_start, '2026-02-01' AS program_end, '2025-12-01' AS apply_start, '2025-12-31' AS apply_end, schedule AS schedule_text, CASE WHEN has_detail OR (seg = 'HOUSEHOLD' AND b > 0) THEN 'text' ELSE 'empty' END AS content_kind,
    reason AS exclusion_reason, reason IS NOT NULL AS is_excluded, warnings, CASE WHEN reason IS NOT NULL THEN 'excluded' WHEN list_contains(warnings, 'INVALID_CORE_FIELD') OR list_contains(warnings, 'CAPACITY_DETAIL_AMBIGUOUS') THEN 'needs_review' WHEN len(warnings) > 0 THEN 'partial' ELSE 'normalized' END AS status,
    CASE WHEN b > 5000 THEN TRUE END AS is_free, CASE WHEN fee_line THEN CASE WHEN b > 5000 THEN '수강료: 무료' ELSE '수강료: 추후 안내' END END AS fee_text, CAST(NULL AS BIGINT) AS material_fee,
    concat(coalesce(lib, '미상'), '::', CASE WHEN b > 8000 THEN '테스트1' WHEN seg = 'HOUSEHOLD' THEN concat('Talk', c_custkey, 'x') ELSE concat('Reading', c_custkey, 'x') END) AS series_key, CASE WHEN b <= 8000 AND seg <> 'HOUSEHOLD' THEN '4/11(토)' END AS occurrence
  FROM warned
)"""


def _board(t) -> DataFrame:
    b, k, seg, n = F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    title = F.when(b > 8000, " 테스트 1 ").when(seg == "HOUSEHOLD", F.concat(F.lit("Talk "), n, F.lit(" x"))).otherwise(F.concat(F.lit("["), "tag", F.lit("] Reading "), n, F.lit(" x 4/11(토)")))
    text = lambda c: c.cast("string")
    basics = F.create_map(
        F.lit("대상"), F.concat(F.when(b > 1000, "일반인").otherwise("누구나"), F.when(b > 2000, "  성인 모두").otherwise("")), F.lit("모집인원"), F.when(b > 7000, "미정").otherwise(text(k)), F.lit("교육기간"), F.lit("2026-01-01 ~ 2026-02-01"),
        F.lit("신청기간"), F.lit("2025-12-01~2025-12-31 "), F.lit("교육시간"), F.when(b < -500, "미정").otherwise(" 화 10:00"), F.lit("강사"), F.lit(" Kim "),
    )
    capacity = F.when(b > 6500, F.concat(F.lit("정원 "), text(k + 1), F.lit("명\n"), text(k + 2), F.lit("명 추첨\n"))).when(b > 6000, F.concat(F.lit("해당 강좌는 "), text(k + 1), F.lit("명이 수업 가능\n"))).otherwise("")
    fee = F.when(b > 5000, "수강료: 무료\n").when(b > 4000, "수강료: 추후 안내\n").otherwise("")
    detail = F.when(b > 3000, F.concat(F.lit("About\n"), capacity, fee)).otherwise(" ")
    body = F.when((seg == "HOUSEHOLD") & (b > 0) & (b <= 8000), F.concat(F.lit("intro\n비고 : NATION_0\n장 소 : 넓은 "), "n_name", F.lit("\n장소: NATION_0")))
    posts = _tagged(t).select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("source_url"), title.alias("title"), basics.alias("basics"), body.alias("body"), detail.alias("detail"), F.lit(None).cast("string").alias("notices"), F.lit(None).cast("string").alias("online_status"), F.lit(0).alias("n_tables"), F.lit(0).alias("n_images"), F.lit(0).alias("n_attachments"), F.lit(False).alias("unmapped"))
    return normalise_programmes(posts, _entries(t), _labels(t), ["none"])


@query("o_k14_normalise", f"WITH {_BOARD} SELECT * FROM board")
def normalised(t):
    return _board(t).drop("source_url", "title_tags", "description", "online_status", "notice_text")


@query("o_k15_board", f"""WITH {_BOARD}, kept AS (SELECT *, count(*) OVER (PARTITION BY library_name, target_group) AS alike FROM board WHERE NOT is_excluded)
SELECT coalesce(library_name, 'UNKNOWN') AS library, coalesce(target_group, 'UNKNOWN') AS audience, any_value(alike) AS n, count_if(status = 'normalized') AS normalized, count_if(status = 'needs_review') AS needs_review, count_if(capacity IS NOT NULL) AS with_capacity, count_if(coalesce(is_free, FALSE)) AS free, min(source_id) AS first_id
FROM kept GROUP BY 1, 2""")
def board(t):
    kept = _board(t).filter("NOT is_excluded")
    named = kept.groupBy(F.coalesce("library_name", F.lit("UNKNOWN")).alias("library"), F.coalesce("target_group", F.lit("UNKNOWN")).alias("audience"))
    return named.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "normalized").alias("normalized"), F.count_if(F.col("status") == "needs_review").alias("needs_review"), F.count("capacity").alias("with_capacity"), F.count_if("is_free").alias("free"), F.min("source_id").alias("first_id"))


# Each part a programme with an attachment whose items repeat, contradict or add to what the part says, by its size.
@query("o_r11_attachment_audit", """SELECT p_partkey AS key,
  concat_ws(',', CASE WHEN p_size > 40 THEN 'content/첨부 표기명' END, CASE WHEN p_size <= 20 THEN 'basicInfo/교육장소' END, CASE WHEN p_size % 3 = 0 THEN 'basicInfo/교재비' END, 'operation/준비물', CASE WHEN p_size % 4 > 0 THEN 'operation/준비물' END) AS added,
  concat_ws(',', CASE WHEN p_size <= 40 THEN '프로그램명' END, CASE WHEN p_size % 2 = 0 THEN '수강인원' END, CASE WHEN p_size > 20 THEN '교육장소' END, CASE WHEN p_size % 5 = 0 THEN '재료비' END) AS skipped,
  concat_ws(',', 'DISPLACED_BY_FULLER_VALUE', 'TABLE_NOISE') AS discarded,
  concat_ws(',', CASE WHEN p_size % 2 = 1 THEN 'ATTACHMENT_CAPACITY_CONFLICT' END, CASE WHEN p_size % 5 > 0 THEN 'ATTACHMENT_FEE_CONFLICT' END) AS warnings,
  CASE WHEN p_size % 4 > 0 THEN 'scissors and other things of their own' ELSE 'paper and glue, all of it' END AS materials, CASE WHEN p_size % 2 = 1 OR p_size % 5 > 0 THEN 'MANUAL_REVIEW_REQUIRED' ELSE 'AUTO_REVIEW_CANDIDATE' END AS review FROM part""")
def attachment_audit(t):
    s, text = F.col("p_size"), lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    fee = F.concat(F.lit("재료비 "), text(s), F.lit(",000원"))
    programmes = t.part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("title"), none.alias("target"), text(s).alias("capacity"), none.alias("instructor"), none.alias("schedule"), F.concat(F.lit("hall of "), "p_brand").alias("location"), fee.alias("fee"), F.lit(0.8).alias("score"))
    items = [
        ("프로그램명", F.when(s > 40, "something else").otherwise(F.concat(F.lit("<"), "p_name", F.lit(">")))), ("수강인원", F.when(s % 2 == 1, "00").otherwise(text(s))), ("교육장소", F.when(s > 20, F.col("p_brand")).otherwise("across the road")), ("재료비", F.when(s % 5 == 0, fee).otherwise(F.lit("77원"))),
        ("교재비", F.when(s % 3 == 0, "없음")), ("준비물", F.lit("paper and glue, all of it")), ("준비물", F.when(s % 4 > 0, "scissors and other things of their own").otherwise("scissors")), ("준비물", F.lit("및 재료비")),
    ]
    rows = t.part.select(F.col("p_partkey").alias("key"), F.posexplode(F.array(*[F.struct(F.lit(a).alias("label"), b.alias("value")) for a, b in items])).alias("n", "x")).select("key", "n", "x.label", "x.value")
    board = t.part.select(F.col("p_partkey").alias("key"), F.lit(0).alias("n"), F.lit("content").alias("section"), F.lit("준비물").alias("label"), F.lit("paper and glue, all of it").alias("value"))
    found = merge_attachments(programmes, rows, board)
    joined = lambda c, f: F.concat_ws(",", F.transform(c, f))
    return found.select(
        "key", joined("added", lambda a: F.concat_ws("/", a["section"], a["label"])).alias("added"), joined("skipped", lambda a: a["label"]).alias("skipped"), joined("discarded", lambda a: a["reason"]).alias("discarded"), joined("warnings", lambda a: a["code"]).alias("warnings"),
        F.get(F.filter("items", lambda i: i["section"] == "operation"), F.lit(0))["value"].alias("materials"), "review",
    )
