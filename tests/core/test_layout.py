"""Pages of text boxes as scanned plans have them: lines, columns, and the rows of a session table under its header."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import layout
from lectern.operators.layout import column_sessions, line_texts, page_sessions, session_mark, split_columns, with_lines

SCHEMA = "page int, text string, left double, top double, right double, bottom double"


def box(text, left, top, width=None, height=20):
    return text, float(left), float(top), float(left + (len(text) * 10 if width is None else width)), float(top + height)


def plan():
    out = [box("차시", 140, 0, 40), box("세부", 449, 0, 40), box("교육내용", 489, 0, 80), box("교수방법", 838, 0, 80)]
    for i, title in enumerate(("오일파스텔 기초 연습", "눈 내린 오두막집 그리기", "케이크 테이블 그리기", "플라워리스 그리기")):
        top = 60 + i * 60
        out += [box(f"{i + 1}회차", 140, top + 15, 50), box("-", 257, top, 10), box(title, 283, top, 300)]
    return out


def dated():
    out = [box("교육일자", 140, 0, 80), box("동화명", 600, 0, 60)]
    for i, title in enumerate(("신기한 씨앗가게", "우리는 친구", "북극곰이 녹아요")):
        out += [box(f"9/{6 + i * 7}", 140, 60 + i * 60, 60), box(title, 600, 60 + i * 60, 200)]
    return out


def spaced():
    out = [box("차시", 14, 0, 32), box("일자", 59, 0, 32), box("시간", 103, 0, 32), box("세부 교육내용", 235, 0, 110)]
    for i, title in enumerate(("클로드 모네의 인상주의", "마르크 샤갈의 사랑의 색채란", "피에트 몬드리안")):
        top = 60 + i * 60
        out += [box(str(i + 1), 14, top, 16), box(f"10/{10 + i * 7}", 59, top, 40), box("2", 103, top, 16), box(title, 235, top, 220)]
    return out


def two_columns():
    return [b for i in range(4) for b in (box(f"{i + 1} 왼쪽활동{i + 1}", 0, i * 40), box(f"{i + 5} 오른쪽활동{i + 1}", 600, i * 40))]


def two_line_header():
    """The session column's name stands above the content column's; the last row's band takes the footer, which goes."""
    out = [box("회차", 0, 0, 40), box("비고", 500, 0, 40), box("교육내용", 200, 30, 80)]
    out += [box("1", 0, 80, 10), box("첫 수업", 150, 80, 100), box("2", 0, 140, 10), box("둘째 수업", 150, 140, 100), box("작성일 2026. 1. 1.", 150, 200, 200)]
    return out


def frame(spark, pages):
    return spark.createDataFrame([(k, *b) for k, boxes in pages.items() for b in boxes], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def pages():
    category = [box("차시", 0, 0, 40), box("주제", 100, 0, 40), box("활동 내용", 300, 0, 90)]
    for i in range(2):
        category += [box(f"{i + 1}", 0, 60 + i * 60, 10), box(f"갈래{i}", 100, 60 + i * 60, 50), box(f"활동{i}", 300, 60 + i * 60, 80)]
    gone = [b for b in plan() if b[0] != "2회차"]
    later = [box("차시", 0, 0, 40), box("내용", 200, 0, 40), *(b for i in (1, 2, 5) for b in (box(str(i), 0, i * 60, 10), box(f"수업{i}", 200, i * 60, 60)))]
    mixed = [box("날짜", 0, 0, 40), box("내용", 200, 0, 40), box("5/7", 60, 60, 30), box("가", 200, 60, 20), box("1", 0, 120, 10), box("나", 200, 120, 20), box("5/14", 60, 180, 30), box("다", 200, 180, 20)]
    return {1: plan(), 2: gone, 3: dated(), 4: spaced(), 5: two_columns(), 6: two_line_header(), 7: category, 8: later, 9: mixed}


def test_session_tables(spark, pages):
    found = {}
    for r in page_sessions(frame(spark, pages), "page").collect():
        found.setdefault(r.page, []).append((r.session, r.date, r.activity))
    found = {k: sorted(v, key=lambda x: x[0]) for k, v in found.items()}
    assert [s for s, _, _ in found[1]] == [1, 2, 3, 4]
    assert found[1][0][2] == "- 오일파스텔 기초 연습"
    assert 2 not in found and 5 not in found
    assert found[3] == [(1, "9/6", "신기한 씨앗가게"), (2, "9/13", "우리는 친구"), (3, "9/20", "북극곰이 녹아요")]
    assert [(s, a) for s, _, a in found[4]] == [(1, "클로드 모네의 인상주의"), (2, "마르크 샤갈의 사랑의 색채란"), (3, "피에트 몬드리안")]
    assert found[6] == [(1, None, "첫 수업"), (2, None, "둘째 수업")]
    assert found[7] == [(1, None, "갈래0\n활동0"), (2, None, "갈래1\n활동1")]
    assert found[8] == [(1, None, "수업1"), (2, None, "수업2")]
    assert found[9] == [(1, "5/7", "가\n나"), (2, "5/14", "다")]


def test_columns(spark, pages):
    split = split_columns(frame(spark, pages), "page")
    assert {r.page: r.n for r in split.groupBy("page").agg(F.countDistinct("col").alias("n")).collect()}[5] == 2
    rows = [(r.col, r.session, r.activity) for r in column_sessions(frame(spark, {1: two_columns(), 2: [box("1 오리엔테이션", 0, 0), box("라포 형성하기", 0, 30), box("2 책 읽고 나누기", 0, 60)]}), "page").orderBy("page", "col", "at").collect()]
    assert rows[:8] == [(0, i + 1, f"왼쪽활동{i + 1}") for i in range(4)] + [(1, i + 5, f"오른쪽활동{i + 1}") for i in range(4)]
    assert rows[8:] == [(0, 1, "오리엔테이션\n라포 형성하기"), (0, 2, "책 읽고 나누기")]
    named = [box("차시", 0, 0, 40), box("내용", 60, 0, 340), box("차시", 410, 0, 40), box("내용", 470, 0, 330), box("1", 0, 60, 10), box("가", 60, 60, 340), box("2", 410, 60, 10), box("나", 470, 60, 330)]
    texts = {(r.col, r.text) for r in split_columns(frame(spark, {1: named}), "page").collect()}
    assert {(0, "가"), (0, "1"), (1, "2"), (1, "나")} <= texts


def test_marks(spark):
    cells = {"1회차": (1, None), "1차시(4.8.)": (1, "4.8."), "5/7": (None, "5/7"), "l": (1, None), "O": None, "가나다": None, "2 회": (2, None), "9.5.(화)": (None, "9/5"), "4월 8일": (None, "4/8"), "41": None, "13/1": None}
    got = {r.t: r.m and tuple(r.m) for r in spark.createDataFrame([(t,) for t in cells], "t string").select("t", session_mark(F.col("t")).alias("m")).collect()}
    assert got == cells


def lines_by_hand(boxes):
    heights = sorted(max(1, b[4] - b[2]) for b in boxes)
    near = max(4, heights[len(heights) // 2] * 0.5)
    lines = []
    for b in sorted(boxes, key=lambda b: (b[2], b[1], b[3], b[0])):
        home = next((line for line in lines if abs((min(x[2] for x in line) + max(x[4] for x in line)) / 2 - (b[2] + b[4]) / 2) <= near), None)
        if home is None:
            lines.append([b])
        else:
            home.append(b)
    lines.sort(key=lambda line: min(x[2] for x in line))
    return [" ".join(b[0] for b in sorted(line, key=lambda b: (b[1], b[2], b[0]))) for line in lines]


def test_lines_of_random_pages(spark):
    rng = random.Random(8)
    pages = {k: [box(f"w{i}", rng.randint(0, 300), rng.randint(0, 120), 10, rng.randint(2, 30)) for i in range(rng.randint(1, 30))] for k in range(60)}
    boxes = frame(spark, pages).unionByName(spark.createDataFrame([(None, "x", 0.0, 0.0, 1.0, 1.0), (1, "y", None, 0.0, 1.0, 1.0)], SCHEMA))
    got = {}
    for r in line_texts(with_lines(boxes, ["page"]), ["page"]).orderBy("page", "line").collect():
        got.setdefault(r.page, []).append(r.text)
    assert got == {k: lines_by_hand(v) for k, v in pages.items()}


def test_no_boxes(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert page_sessions(nothing, "page").count() == 0
    assert column_sessions(nothing, "page").count() == 0


def steps(frame, name):
    """How often an operator stands in the plan."""
    return len(re.findall(rf"\b{name}\b", frame._jdf.queryExecution().executedPlan().toString()))


def test_lines_take_one_shuffle_and_one_sort(spark):
    boxes = spark.range(100).selectExpr("CAST(id % 7 AS INT) AS page", "concat('t', id) AS text", "CAST(id % 5 AS DOUBLE) AS left", "CAST(id % 11 * 9 AS DOUBLE) AS top", "CAST(id % 5 + 4 AS DOUBLE) AS right", "CAST(id % 11 * 9 + 12 AS DOUBLE) AS bottom")
    found = with_lines(boxes, ["page"])
    assert (steps(found, "Exchange"), steps(found, "Sort")) == (1, 1)
    for page in found.toPandas().groupby("page"):
        firsts = page[1].groupby("line")["top"].min()
        assert list(firsts.index) == list(range(len(firsts))) and list(firsts) == sorted(firsts)


def test_columns_take_no_checkpoint_and_two_shuffles(spark):
    boxes = spark.range(40).selectExpr("CAST(id % 2 AS INT) AS page", "concat('t', id) AS text", "CAST(id % 2 * 500 + id % 4 * 100 AS DOUBLE) AS left", "CAST(id * 9 AS DOUBLE) AS top", "CAST(id % 2 * 500 + id % 4 * 100 + 50 AS DOUBLE) AS right", "CAST(id * 9 + 12 AS DOUBLE) AS bottom")
    found = split_columns(boxes, "page")
    assert (steps(found, "Exchange"), steps(found, "Sort"), steps(found, "RDD")) == (2, 2, 0)


def test_header_grid_is_one_small_plan(spark, pages):
    """The driver holds the plan: nothing is stored on the way, the boxes are read by one shuffle, and no bound repeats the search for its cell."""
    found = page_sessions(frame(spark, pages), "page")
    plan = found._jdf.queryExecution()
    assert len(plan.optimizedPlan().toString()) < 100_000
    found.collect()
    ran = plan.executedPlan().toString().split("Initial Plan")[0]
    assert (steps(found, "FileScan"), ran.count("ReusedExchange")) == (0, 1)


def test_lines_that_may_be_headers(spark, monkeypatch):
    """Names torn over boxes, cells and lines: what each box shows for itself leaves out no header."""
    rng = random.Random(5)
    bits = ["차", "시", "회", "기", "교육", "일", "일자", "강의", "강의일시", "명", "차시", "(60분", "분)", "(x)회차", "내", "용", "내용", "교육내용", "프로그", "램명", "주제", "활동", "세부 사", "항", " ", "1", "item", "강", "의명", None]
    pages = {}
    for k in range(250):
        pages[k] = [(rng.choice(bits), float(left), 30.0 * line, left + 20.0, 30.0 * line + 20) for line in range(rng.randint(1, 4)) for left in rng.sample(range(0, 200, 25), rng.randint(1, 6))]
    lined = with_lines(frame(spark, pages), ["page"]).localCheckpoint()
    cells = lambda: sorted((r.page, r.head, r.left, r.right, r.text) for r in layout._header_lines(lined, "page").collect())
    got = cells()
    few = layout._may_be_header(lined, "page").count()
    monkeypatch.setattr(layout, "_may_be_header", lambda lined, key: lined)
    assert got == cells() and len({(page, head) for page, head, *_ in got}) > 50
    assert few < lined.count()
