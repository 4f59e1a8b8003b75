"""Nested and spanned tables, and session tables of every shape that plans have."""

import random

import pytest

from lectern.operators.tables import session_rows, session_table, table_grid
from lectern.sources.html import _Cells, _page_rows, _slots, page_grids, page_rows, table_cells

CELLS = "key int, table_no int, row_no int, col_no int, cell_no int, colspan int, rowspan int, header boolean, text string"


def cells_of(spark, html):
    return [tuple(r)[1:] for r in table_cells(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("table_no", "row_no", "cell_no").collect()]


def grid_of(spark, html):
    slots = table_grid(table_cells(spark.createDataFrame([(1, html)], "page_id int, html string")), "page_id").collect()
    return {(r.table_no, r.row_no, r.col_no): r.text for r in slots}


def test_nested_tables_keep_their_parents_and_the_text_behind(spark):
    html = "<table><tr><td>a<table><tr><td>x</td></tr><tr><td>y</table> z</td><td>b</td></tr><tr><td>c</td></tr></table><table><tr><td>d"
    got = cells_of(spark, html)
    assert got == [
        (0, None, None, None, 0, 0, 0, False, 1, 1, "axy z"), (0, None, None, None, 0, 1, 1, False, 1, 1, "b"), (0, None, None, None, 1, 0, 0, False, 1, 1, "c"),
        (1, 0, 0, 0, 0, 0, 0, False, 1, 1, "x"), (1, 0, 0, 0, 1, 0, 0, False, 1, 1, "y"), (2, None, None, None, 0, 0, 0, False, 1, 1, "d"),
    ]


def test_odd_markup(spark):
    assert [c[-3:] for c in cells_of(spark, '<table><tr><td colspan="²">a</td><td colspan="-1" rowspan="x">b</td><td colspan=" 2 ">c</td><td colspan="1e9">d</td></tr></table>')] == [(1, 1, "a"), (1, 1, "b"), (2, 1, "c"), (1, 1, "d")]
    assert [c[-1] for c in cells_of(spark, "<table><td>a<script>var t = '<td>no</td>'</script><style>p{}</style>b</td><tr><td>c &amp; d</table></table></td>")] == ["ab", "c & d"]
    assert cells_of(spark, "<td>no table</td>") == cells_of(spark, "") == cells_of(spark, None) == []


def test_plain_pages_take_no_parser_and_give_what_it_gives(monkeypatch):
    plain = ["<table><tr><td rowspan=2>a<th colspan='3'>b<table><tr><td>c</table> d<script>var x = 1</script><tr><td>e</table><a href=\"u\">", "x > y", "<td>", "</table><p class='k'><table><td rowspan=x>z"]
    odd = ["<table><tr><td>a &amp; b</table>", "<TABLE><td>a</table>", "<table><td>a<br/>b", "<table><td>a < b", "<table><!-- <td> --><td>b", "<script><td></script>", "<table><td></td >x", "<td><textarea><td>"]
    fed, real = [], _Cells.feed
    monkeypatch.setattr(_Cells, "feed", lambda self, text: (fed.append(text), real(self, text)))
    for text in plain + odd:
        by_parser, by_page = _Cells(), _Cells()
        real(by_parser, text)
        by_parser.close()
        by_page.read(text)
        assert (by_page.finish(), by_page.links) == (by_parser.finish(), by_parser.links)
    assert fed == odd


def test_grids_of_pages_equal_grids_of_their_cells(spark, capsys):
    html = ["<table><tr><td rowspan=9>a<th colspan=3>b<table><tr><td>c<td rowspan=2>d</table><tr><td> <th>e<tr><td rowspan=2 colspan=2><tr><td>f<td>g</table>", "<tr><td>none", None, "<table></table><table><td>&nbsp;x"]
    overlap = "<table><tr><td>a<td rowspan=3><td>b<tr><td colspan=3>c<tr><th colspan=2>d</table>"
    pages = spark.createDataFrame(list(enumerate([*html, overlap])), "page_id int, html string").repartition(2)
    grids = page_grids(pages)
    assert {tuple(r) for r in grids.collect()} == {tuple(r) for r in table_grid(table_cells(pages), "page_id").select(grids.columns).collect()}
    assert grids.count() > 20
    page_grids(pages.localCheckpoint()).explain("simple")
    assert "Exchange" not in capsys.readouterr().out


def test_cells_move_past_slots_of_the_rows_above(spark):
    got = grid_of(spark, "<table><tr><td rowspan=3>a</td><td>b</td><td rowspan=2 colspan=2>c</td></tr><tr><td>d</td><td>e</td></tr><tr><td>f</td><td></td><td>g</td></tr></table>")
    want = [["a", "b", "c", "c"], ["a", "d", "c", "c", "e"], ["a", "f", None, "g"]]
    assert got == {(0, r, c): text for r, row in enumerate(want) for c, text in enumerate(row)}
    assert grid_of(spark, "<table><tr><td rowspan=9>a</td></tr></table>") == {(0, 0, 0): "a"}


def sessions(spark, tables):
    """tables: lists of rows of texts; all of them are one key's."""
    rows = [(1, n, r, c, c, 1, 1, False, text) for n, table in enumerate(tables) for r, row in enumerate(table) for c, text in enumerate(row)]
    grid = table_grid(spark.createDataFrame(rows, CELLS).repartition(3), "key")
    return sorted(tuple(r)[1:] for r in session_table(grid, "key").collect())


ROWS = [("1", "9/3", "읽기", "책"), ("2", "9/10", "쓰기", None)]


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (2, 0, 3, 1), (3, 2, 1, 0)])
@pytest.mark.parametrize("two", [False, True])
def test_columns_in_any_order_and_a_header_of_two_rows(spark, order, two):
    head = [["차시", "", "", ""], ["", "일자", "교육내용", "비고"]] if two else [["차시", "일자", "교육내용", "비고"]]
    table = [[row[i] for i in order] for row in [*head, *ROWS]]
    assert sessions(spark, [table]) == [(1, "9/3", "읽기", "책", None, None, None), (2, "9/10", "쓰기", None, None, None, None)]


def test_sessions_carry_on_and_meet_again(spark):
    table = [["회차", "날짜", "구분", "활동", "교수방법", "준비물"], ["1회차 8/9", "", "도입", "가", "강의", "풀"], ["", "", "", "나", "", ""], ["※ 안내", "", "", "※ 바뀔 수 있음", "", ""], ["2(8/16)", "", "", "다※ 알림", "", ""], ["끝", "", "", "라", "", ""]]
    again = [["차시", "세부 교육내용"], ["1", "나"], ["1", "마"], ["3", "바 ㆍ 사"]]
    got = sessions(spark, [table, again])
    assert got == [(1, "8/9", "가\n나\n마", None, "도입", "강의", "풀"), (2, "8/16", "다※ 알림", None, "도입", None, None), (3, None, "바\n• 사", None, None, None, None)]


def test_numbers_inside_the_content_and_beside_an_empty_name(spark):
    assert [r[:3] for r in sessions(spark, [[["차시 세부 교육내용", "비고"], ["1 첫째", "x"], ["도서\n2 둘째", "y"]]])] == [(1, None, "첫째"), (2, None, "도서\n둘째")]
    assert [r[:3] for r in sessions(spark, [[["Period", "", "Activity"], ["가", "1", "one"], ["나", "2", "two"]]])] == [(1, None, "one"), (2, None, "two")]


def test_tables_without_a_header(spark):
    assert sessions(spark, [[["1", "3/4", "하나", "풀"], ["2", "3/11", "둘", "책"]]]) == [(1, "3/4", "하나", None, None, None, "풀"), (2, "3/11", "둘", None, None, None, "책")]
    assert [r[:4] for r in sessions(spark, [[["가", "3", "3월 4일", "긴 내용이 여기에 있다", "말"], ["나", "4", "3월 11일", "짧음", ""]]])] == [(3, "3월 4일", "긴 내용이 여기에 있다", "말"), (4, "3월 11일", "짧음", None)]
    assert sessions(spark, [[["이름", "값"], ["장소", "강당"]]]) == []
    assert session_table(table_grid(spark.createDataFrame([], CELLS), "key"), "key").count() == 0


def test_pages_with_the_same_tags_share_one_walk_and_give_what_the_parser_gives():
    rng = random.Random(5)
    bits = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "<td rowspan=2>", '<td colspan="3">', "<td rowspan='2' colspan=2>", "<script>", "</script>", " a ", "b\n c", "x", "&amp;", "<p>", "</p>", "> ", "<!-- c -->", "<B>"]
    weights, shapes = [6, 3, 8, 4, 12, 8, 3, 2, 2, 2, 0.3, 0.3, 6, 6, 3, 0.2, 1, 1, 0.3, 0.1, 0.1], {}
    for _ in range(4000):
        page = "<table>" + "".join(rng.choices(bits, weights, k=rng.randint(0, 20)))
        parser = _Cells()
        parser.read(page)
        want = sorted((t, r, c, x) for t, r, c, x, _ in _slots(parser.finish()))
        for _ in range(2):
            rows, texts = _page_rows(page, shapes)
            got = sorted(((t, r, c, next((texts[i] for i in over if texts[i]), None)) for t, r, slots in rows for c, over in slots))
            assert got == want, page
    assert 0 < len(shapes) <= 512


def test_sessions_of_pages_take_one_shuffle_and_nothing_is_stored(spark):
    pages = spark.createDataFrame([(1, "<table><tr><th>차시</th><th>활동</th></tr><tr><td>1</td><td>가</td></tr></table>"), (2, None)], "key int, html string")
    rows = page_rows(pages, "key")
    assert sorted((r.key, r.table_no, r.row_no, r.cells) for r in rows.collect()) == [(1, 0, 0, {0: "차시", 1: "활동"}), (1, 0, 1, {0: "1", 1: "가"})]
    plan = session_rows(rows, "key")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("MapInArrow") == 1
