"""Section matching on pages of plans, and the score of a page for a title."""

import pytest
from pyspark.sql import functions as F

from lectern.operators.sections import comparable, match_sections, title_segments


def matched(spark, cases):
    """cases: name -> (pages, title, known titles, single)."""
    pages = [(k, n, text) for k, (texts, *_) in cases.items() for n, text in texts]
    targets = [(k, title, single) for k, (_, title, _, single) in cases.items()]
    known = [(k, t) for k, (_, _, titles, _) in cases.items() for t in titles]
    frames = spark.createDataFrame(pages, "doc string, page int, text string").repartition(3), spark.createDataFrame(targets, "doc string, title string, single boolean"), spark.createDataFrame(known, "doc string, title string")
    return {r.doc: (r.status, r.pages, round(r.score, 6), r.text) for r in match_sections(*frames).collect()}


def test_sections(spark):
    two = [(1, "표지"), (2, "자녀 독서지도\n1회차 책 읽기"), (3, "계속되는 내용"), (4, "생각 쑥쑥 그림책\n새 프로그램")]
    title, both = "[미리내] 자녀 독서지도", ["[미리내] 자녀 독서지도", "[미리내] 생각 쑥쑥 그림책"]
    alias = [(1, "생활영어 강의계획서 프로그램명 매체를 통해 배우는 생활 영어"), (2, "학부모 독서지도 계획안 *미리내 도서관 프로그램명 책 읽기로 몸과 마음 성장하기"), (3, "어린이 그림책 지도 계획안 프로그램명 생각 쏙쏙 그림책")]
    again = [(1, "자녀 독서지도\n하나"), (2, "사이"), (3, "자녀 독서지도\n둘")]
    appendix = [(1, "자녀 독서지도\n하나"), (2, "본문"), (3, "[붙임 1] 자료"), (4, "본문")]
    near = [(1, "자녀 독서지도반\n하나"), (2, "자녀 독서지도반 이야기"), (3, "독서지도 자녀"), (4, None)]
    got = matched(spark, {
        "two": (two, title, both, False), "single": (two, title, both, True), "alias": (alias, title, [], False),
        "inserted": ([(10, "강의계획서 프로그램명 생각 톡톡! 창의력up! 미술아 놀자!")], "[부곡 1동] 생각톡톡! 미술아 놀자", [], False),
        "again": (again, title, [title], False), "again, others": ([*again, (4, "생각 쑥쑥 그림책")], title, both, False),
        "none": ([(1, "다른 것"), (2, "")], title, both, True), "appendix": (appendix, title, [title], False), "near": (near, title, [title], False),
    })
    assert got["two"][:2] == ("SECTION_MATCHED", [2, 3])
    assert "새 프로그램" not in got["two"][3] and got["two"][3].count("\n\n") == 1
    assert got["single"][:3] == ("WHOLE_DOCUMENT", [1, 2, 3, 4], 1.0)
    assert got["alias"][:2] == ("SECTION_MATCHED", [2])
    assert got["inserted"][:2] == ("SECTION_MATCHED", [10])
    assert got["again"][:2] == ("WHOLE_DOCUMENT", [1, 2, 3])
    assert got["again, others"] == ("AMBIGUOUS", [1, 3], 0.4, "")
    assert got["none"] == ("NOT_FOUND", [], 0.0, "")
    assert got["appendix"][:2] == ("SECTION_MATCHED", [1, 2])
    assert got["near"][0] == "WHOLE_DOCUMENT" and got["near"][1] == [1, 2, 3, 4]


def test_comparable(spark):
    rows = ["[미리내] 자녀 독서지도", "  [a][b] Ｆｕｌｌ-Width ２기!", "", None]
    got = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", comparable(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == ["자녀독서지도", "fullwidth2기", "", None]


@pytest.mark.parametrize("empty", ["pages", "targets", "known"])
def test_empty_tables(spark, empty):
    frames = {"pages": ([(1, 1, "abcd efgh")], "doc int, page int, text string"), "targets": ([(1, "abcd efgh", None)], "doc int, title string, single boolean"), "known": ([(1, "abcd efgh")], "doc int, title string")}
    made = [spark.createDataFrame([] if name == empty else rows, kind) for name, (rows, kind) in frames.items()]
    assert [r.status for r in match_sections(*made).collect()] == (["SECTION_MATCHED"] if empty == "known" else [])


def test_segments_take_one_sort_that_moves_no_texts(spark):
    lines = spark.range(60).selectExpr("id % 3 AS image", "id AS line", "concat('제목 ', id) AS text", "CAST(10 + id % 9 AS INT) AS height", "2 AS linked")
    plan = title_segments(lines, "image")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange ") == 1


def test_pages_are_told_once_and_meet_known_titles_by_document(spark):
    pages = spark.range(40).selectExpr("id % 4 AS doc", "CAST(id AS INT) AS page", "concat('title ', id % 3, ' Ｆｕｌｌ') AS text")
    targets, known = pages.selectExpr("doc", "'title 1' AS title", "FALSE AS single").distinct(), pages.selectExpr("doc", "concat('title ', page % 2) AS title")
    plan = match_sections(pages, targets, known)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and plan.count("Range (") == 3
