"""Dictionary look-ups, body lines, fees, series, typed rows, and segments by title anchors."""

import pytest
from pyspark.sql import functions as F

from lectern.operators.normalise import containments, dictionary_lookup, fees, label_line, normalise_programmes, series_of, structure_bodies, tag_text
from lectern.operators.sections import title_segments

ENTRIES = "ord int, canonical string, contains array<string>, equals array<string>"
LABELS = "label string, field string, section string"


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame([(2, "우지", ["우지"], []), (1, "금샘마을", ["금샘 마을", ""], []), (3, "솔", [], ["솔"]), (4, "우지 다른", ["우지"], ["솔"])], ENTRIES)


def test_tags(spark, entries):
    assert column(spark, ["금샘마을(사립)", "사립 우지", "비대면 - 우지", "공립/A b", None], tag_text) == ["금샘마을", "우지", "우지", "/ab", ""]
    tags = spark.createDataFrame([("금샘마을(사립)",), ("x/솔",), ("솔잎",), ("공립 우지/금샘마을",), ("행사",), ("(행사)",), (None,), ("x/솔",)], "tag string")
    got = {r.tag: (r.canonical, r.known_negative) for r in dictionary_lookup(tags, "tag", entries, ["행사"]).collect()}
    assert got == {"금샘마을(사립)": ("금샘마을", False), "x/솔": ("솔", False), "솔잎": (None, False), "공립 우지/금샘마을": ("금샘마을", False), "행사": (None, True), "(행사)": (None, False), None: (None, False)}
    assert dictionary_lookup(tags, "tag", entries.limit(0)).filter("canonical IS NOT NULL OR known_negative").count() == 0


def test_containments(spark):
    names = ["ab", "ABC", "xabcx", "b", "q", "", None, "ab", "Ab"]
    got = {(r.whole, r.part) for r in containments(spark.createDataFrame([(n,) for n in names], "n string"), "n").collect()}
    known = {n for n in names if n}
    assert got == {(a, b) for a in known for b in known if a != b and b.lower() in a.lower()}
    assert containments(spark.createDataFrame([], "n string"), "n").count() == 0


def test_label_lines(spark):
    lines = [" 1. 수 강 료 : 무료", " 장소：강당", "no label", "시간: ", "아주아주아주아주아주 긴 이름이다: x", ": x", None]
    assert [x and tuple(x) for x in column(spark, lines, label_line)] == [("수강료", "수 강 료", "무료"), ("장소", "장소", "강당"), None, ("시간", "시간", ""), None, None, None]


def test_bodies(spark):
    labels = spark.createDataFrame([("장소", "location", "operation"), ("대상", "target", "operation"), ("기타", None, None)], LABELS)
    body = "(열기)\n장소: 강당\n(이층)\n[표]\n— 옆문\n대상: 모두\n(끝)\n제목!\n주차장이 없습니다.\n주차장이 없습니다 .\n기타: x\n날짜: y\n- 주차장은 좁습니다."
    rows = [(1, body, "주차장이  없습니다.\n알림", ["제목", None], "가[표]나"), (2, None, None, None, None), (3, "", "", [], "")]
    posts = spark.createDataFrame(rows, "k int, body string, notices string, basics array<string>, table_text string")
    found = [tuple(r)[1:] for r in structure_bodies(posts, "k", labels, [("park", ["주차장"])], ["target"]).orderBy("k", "kind", "position").collect()]
    assert found == [
        ("intro", None, 0, None, "(열기)"), ("intro", None, 1, None, "(끝)"), ("intro", None, 2, None, "주차장이 없습니다 ."), ("intro", None, 3, None, "기타: x"), ("intro", None, 4, None, "날짜: y"),
        ("item", "operation", 0, "장소", "강당 (이층) — 옆문"), ("notice", "park", 0, None, "주차장이 없습니다."), ("notice", "park", 1, None, "- 주차장은 좁습니다."), ("notice", "etc", 2, None, "알림"), ("unmapped", None, 0, "날짜", None),
    ]


def test_fees_and_series(spark):
    cases = {"수강료: 무료": (True, "수강료: 무료", None, False), "x\n 재료비 5,000원 \n재 료 비 약 6,000원": (None, "재료비 5,000원\n재 료 비 약 6,000원", None, True), "참가비 1원, 재료비 2,000원": (False, "참가비 1원, 재료비 2,000원", 2000, False), "none": (None, None, None, False), None: (None, None, None, False)}
    assert [tuple(x) for x in column(spark, list(cases), fees)] == list(cases.values())
    titles = {"[우지] 동화나라[4/11(토)]": ("우지::동화나라", "4/11(토)"), "6월 벙개 독서회 (2차)": ("우지::벙개독서회", "6월 (2차)"), "풍선아트 13:00 ~ 13:20": ("우지::풍선아트", "13:00 ~ 13:20"), "4/11": ("우지::4/11", "4/11"), "그냥": ("우지::그냥", None)}
    assert [tuple(x) for x in column(spark, list(titles), lambda c: series_of(c, F.lit("우지")))] == list(titles.values())
    assert column(spark, ["a"], lambda c: series_of(c, F.lit(None).cast("string"))["series_key"]) == ["미상::a"]


POSTS = "source_id int, source_url string, title string, basics map<string,string>, body string, detail string, notices string, online_status string, n_tables int, n_images int, n_attachments int, unmapped boolean"


def test_typed_rows(spark, entries):
    labels = spark.createDataFrame([("장소", "location", "operation")], LABELS)
    full = {"대상": "초등학생 1~3학년", "모집인원": "15", "교육기간": "2026-03-01 ~ 2026-03-08", "신청기간": "2026-02-01~2026-02-10", "교육시간": "10:00", "강사": " 홍 "}
    rows = [
        (1, "u", "[우지] 책 읽기 3/1", full, None, "정원 15명\n수강료: 무료", " ", "접수", 1, 0, 0, None), (2, "u", "책 읽기", full, "장소: 공립 우지", "정원 20명", None, None, 0, 0, 0, True),
        (3, "u", "[행사] 책", {**full, "모집인원": "많이"}, None, None, None, None, 0, 2, 0, False), (4, "u", "test 3", None, None, "", None, None, 0, 0, 1, False), (5, None, None, {}, None, None, None, None, 0, 0, 0, None),
        (6, "u", "[x][솔] 책", full, None, "정원 1명, 2명 추첨", None, None, 0, 0, 0, False),
    ]
    got = {r.source_id: r for r in normalise_programmes(spark.createDataFrame(rows, POSTS), entries, labels, ["행사"]).collect()}
    assert (got[1].library_name, got[1].library_source, got[1].capacity, got[1].status, got[1].warnings, got[1].occurrence, got[1].content_kind) == ("우지", "title_tag", 15, "normalized", [], "3/1", "table")
    assert (got[1].target_group, got[1].target_detail, got[1].program_start, got[1].apply_end, got[1].instructor, got[1].notice_text) == ("초등학생", "1~3학년", "2026-03-01", "2026-02-10", "홍", None)
    assert (got[2].library_source, got[2].capacity, got[2].warnings, got[2].status) == ("body_location", 20, ["CAPACITY_OVERRIDDEN_BY_DETAIL", "UNMAPPED_LABEL_IN_BODY"], "partial")
    assert (got[3].known_non_library, got[3].capacity, got[3].warnings, got[3].content_kind) == (True, None, ["INVALID_CORE_FIELD", "DESCRIPTION_MISSING"], "image")
    assert (got[4].exclusion_reason, got[4].status, got[4].content_kind) == ("TEST_TITLE", "excluded", "attachment_only")
    assert (got[5].exclusion_reason, got[5].title, got[5].content_kind) == ("SCHEDULE_WITHOUT_ANY_DIGIT", "", "empty")
    assert (got[6].library_name, got[6].title_tags, got[6].capacity, got[6].status) == ("솔", ["x", "솔"], 15, "needs_review")


def test_segments(spark):
    def lines(key, linked, *rows):
        return [(key, i, text, height, linked) for i, (text, height) in enumerate(rows)]

    title, when, plain, contact = ("여름 독서", 30), ("일시 7/1", 10), ("말", 10), ("문의 도서관", 30)
    shared = [plain, title, when, plain, title, plain, plain, when, title, plain, plain, plain, plain, plain, when]
    rows = lines(1, 3, *shared) + lines(2, 1, *shared) + lines(3, 2, title, when, contact, when) + lines(4, 1, (None, None)) + lines(5, 2, *[title, when, plain] * 4)
    got = {}
    for r in title_segments(spark.createDataFrame(rows, "k int, line int, text string, height int, linked int"), "k").orderBy("k", "line").collect():
        got.setdefault(r.k, []).append((r.line, r.segment, r.kind[:7]))
    assert got[1] == [(i, 0 if i < 4 else 1, "PROGRAM") for i in range(1, 15)]
    assert got[2] == [(i, 0, "WHOLE_D") for i in range(15)]
    assert got[3] == [(i, 0, "WHOLE_D") for i in range(4)]
    assert got[4] == [(0, 0, "WHOLE_D")]
    assert [s for _, s, _ in got[5]] == [0] * 3 + [1] * 3 + [2] * 6


def test_posts_of_parts_are_dealt_out(spark, capsys):
    import lectern.plans  # noqa: F401
    from lectern.registry import QUERIES

    QUERIES["o_x22_sections"](spark, "/root/testdata/sf0.001").explain("simple")
    assert "REPARTITION_BY_COL" in capsys.readouterr().out
