"""Structured rows from scanned pages, tables and document texts, over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.layout import boxes_to_lines, column_sessions, page_sessions
from ..operators.sections import match_sections, title_segments
from ..operators.tables import session_rows as sessions_of_rows
from ..registry import query
from ..sources.html import page_grids, page_rows, table_cells
from ..storage import stored

_ITEMS = """SELECT l_orderkey, l_partkey, l_returnflag, l_linestatus, l_shipdate, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r,
  count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem"""


def _items(t, rows: DataFrame | None = None) -> DataFrame:
    """The items of each order in order (r from 1), and how many they are (n); rows: the items with further columns."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    n = F.count("*").over(Window.partitionBy("l_orderkey"))
    if rows is not None:
        return rows.withColumn("r", F.row_number().over(order)).withColumn("n", n)
    return t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus", "l_shipdate", F.row_number().over(order).alias("r"), n.alias("n"))


def _box(text, left, top, width, height=20.0):
    left, top = F.lit(left).cast("double"), F.lit(top).cast("double")
    return F.struct(left.alias("left"), top.alias("top"), (left + width).alias("right"), (top + height).alias("bottom"), text.alias("text"))


@query("o_r9_layout_lines", "SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS line, text FROM (SELECT l_orderkey, l_linenumber, string_agg(l_returnflag, ' ' ORDER BY l_quantity, l_returnflag) AS text FROM lineitem GROUP BY 1, 2)")
def layout_lines(t):
    b = t.lineitem.select("l_orderkey", F.col("l_quantity").alias("left"), (F.col("l_linenumber") * 20.0).alias("top"), (F.col("l_quantity") + 5).alias("right"), (F.col("l_linenumber") * 20.0 + 12).alias("bottom"), F.col("l_returnflag").alias("text"))
    return boxes_to_lines(b, "l_orderkey")


# Each order is a page with its items in two columns, a numbered line and one more for each; a page of under eight boxes is read across.
@query("o_r9_columns", f"""WITH items AS ({_ITEMS}), wide AS (
  SELECT *, lead(l_partkey) OVER w AS p2, lead(l_returnflag) OVER w AS f2 FROM items WINDOW w AS (PARTITION BY l_orderkey ORDER BY r)
)
SELECT l_orderkey, CASE WHEN n >= 4 THEN CAST((r - 1) % 2 AS INTEGER) ELSE 0 END AS col, CAST(r AS INTEGER) AS session,
  concat('item ', l_partkey, CASE WHEN n < 4 AND p2 IS NOT NULL THEN concat(' ', r + 1, ' item ', p2) ELSE '' END, chr(10), l_returnflag, CASE WHEN n < 4 AND f2 IS NOT NULL THEN concat(' ', f2) ELSE '' END) AS activity
FROM wide WHERE n >= 4 OR r % 2 = 1""")
def layout_columns(t):
    left, top = F.when(F.col("r") % 2 == 1, 0.0).otherwise(600.0), F.floor((F.col("r") - 1) / 2) * 60.0
    numbered = F.concat_ws(" ", F.col("r").cast("string"), F.lit("item"), F.col("l_partkey").cast("string"))
    boxes = _items(t).select("l_orderkey", F.inline(F.array(_box(numbered, left, top, 300.0), _box(F.col("l_returnflag"), left, top + 30, 20.0))))
    return column_sessions(boxes, "l_orderkey").select("l_orderkey", "col", "session", "activity")


# Each order is a page with a session table.  Urgent ones give dates in place of numbers, low ones have no header, and of those without a priority the numbers begin at 2.
@query("o_r9_header_grid", f"""WITH items AS ({_ITEMS})
SELECT l_orderkey, CAST(r AS INTEGER) AS session, CASE WHEN o_orderpriority LIKE '1%' THEN concat(month(l_shipdate), '/', day(l_shipdate)) END AS date,
  concat('item ', l_partkey, chr(10), l_returnflag, ' ', l_linestatus) AS activity
FROM items JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority NOT LIKE '5%' AND o_orderpriority NOT LIKE '4%'""")
def layout_header_grid(t):
    kinds = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.substring("o_orderpriority", 1, 1).alias("kind"))
    # Merged, however small the file of orders looks: the driver need not hold them.
    pages = _items(t).join(kinds.hint("merge"), "l_orderkey")
    top = F.col("r") * 60.0
    date = F.concat_ws("/", F.month("l_shipdate").cast("string"), F.dayofmonth("l_shipdate").cast("string"))
    number = F.when(F.col("kind") == "1", date).when(F.col("kind") == "2", F.concat(F.col("r").cast("string"), F.lit("회차"))).when(F.col("kind") == "4", (F.col("r") + 1).cast("string")).otherwise(F.col("r").cast("string"))
    cells = [_box(number, 140.0, top + 15, 30.0), _box(F.concat(F.lit("item "), F.col("l_partkey").cast("string")), 283.0, top, 200.0), _box(F.col("l_returnflag"), 283.0, top + 20, 20.0), _box(F.col("l_linestatus"), 320.0, top + 20, 20.0), _box(F.lit("강의"), 838.0, top, 40.0)]
    names = [(F.when(F.col("kind") == "1", "교육일자").otherwise("차시"), 140.0, 40.0), (F.lit("세부"), 449.0, 40.0), (F.lit("교육내용"), 489.0, 80.0), (F.lit("교수방법"), 838.0, 80.0)]
    heads = [_box(text, left, 0.0, width) for text, left, width in names]
    boxes = F.when((F.col("r") == 1) & (F.col("kind") != "5"), F.array(*heads, *cells)).otherwise(F.array(*cells))
    return page_sessions(pages.select("l_orderkey", F.inline(boxes)), "l_orderkey")


# Each order is a document, each of its items a page: a titled one (N), one that goes on (R), an appendix or another section's beginning (A).
_FILES = f"""items AS ({_ITEMS}), named AS (
  SELECT l_orderkey AS doc, CAST(r AS INTEGER) AS page, l_returnflag AS flag, l_linestatus AS state, p_name, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS comp FROM items JOIN part ON p_partkey = l_partkey
), texts AS (
  SELECT *, CASE WHEN flag = 'N' THEN concat(p_name, chr(10), 'begins') WHEN flag = 'R' THEN 'goes on' WHEN state = 'F' THEN '[붙임] 1' ELSE '강좌명 2' END AS text FROM named
), asked AS (SELECT doc, min_by(p_name, page) AS p_name, min_by(comp, page) AS target FROM texts WHERE flag = 'N' GROUP BY doc),
scored AS (
  SELECT t.*, coalesce(a.p_name, 'quite unknown') AS title, a.target, o_orderstatus = 'F' AS single,
    CASE WHEN flag <> 'N' OR target IS NULL THEN 0.0 WHEN contains(comp, target) OR contains(target, comp) THEN 0.95 ELSE least(0.95, 1 - levenshtein(comp, target) / greatest(length(comp), length(target))::DOUBLE) END AS score,
    flag = 'A' AS boundary
  FROM texts t LEFT JOIN asked a USING (doc) JOIN orders ON o_orderkey = doc
), marked AS (
  SELECT s.*, coalesce(s.flag = 'N' AND (SELECT bool_or(k.comp <> s.target AND contains(concat(s.comp, 'begins'), k.comp)) FROM texts k WHERE k.doc = s.doc AND k.flag = 'N' AND length(k.comp) >= 4), FALSE) AS other FROM scored s
), best AS (SELECT *, max(score) OVER w AS best, bool_or(other) OVER w AS any_other FROM marked WINDOW w AS (PARTITION BY doc)),
placed AS (
  SELECT *, sum(CASE WHEN score = best AND score >= 0.55 THEN 1 ELSE 0 END) OVER w AS hits, min(CASE WHEN score >= 0.55 AND score >= best - 0.1 THEN page END) OVER w AS start FROM best WINDOW w AS (PARTITION BY doc)
), ended AS (
  SELECT *, min(CASE WHEN page > start AND (boundary OR other) THEN page END) OVER (PARTITION BY doc) AS stop,
    CASE WHEN hits = 0 THEN 'NOT_FOUND' WHEN single OR (hits > 1 AND NOT any_other) THEN 'WHOLE_DOCUMENT' WHEN hits > 1 THEN 'AMBIGUOUS' ELSE 'SECTION_MATCHED' END AS status FROM placed
)
SELECT doc, title, status, CAST(max(CASE status WHEN 'NOT_FOUND' THEN 0.0 WHEN 'AMBIGUOUS' THEN 0.4 ELSE CASE WHEN single THEN 1.0 ELSE best END END) AS DOUBLE) AS score,
  coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (kept), '') AS pages, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page) FILTER (kept AND status <> 'AMBIGUOUS'), '') AS text
FROM (SELECT *, CASE status WHEN 'WHOLE_DOCUMENT' THEN TRUE WHEN 'AMBIGUOUS' THEN score = best WHEN 'SECTION_MATCHED' THEN page >= start AND (stop IS NULL OR page < stop) ELSE FALSE END AS kept FROM ended)
GROUP BY doc, title, status"""


@query("o_r10_sections", f"WITH {_FILES}")
def sections_of_files(t):
    named = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    pages = _items(t, named)
    flag = F.col("l_returnflag")
    text = F.when(flag == "N", F.concat("p_name", F.lit("\nbegins"))).when(flag == "R", F.lit("goes on")).when(F.col("l_linestatus") == "F", F.lit("[붙임] 1")).otherwise(F.lit("강좌명 2"))
    pages = pages.select(F.col("l_orderkey").alias("doc"), F.col("r").cast("int").alias("page"), text.alias("text"), F.when(flag == "N", F.col("p_name")).alias("name"))
    pages = stored(pages, "pages")  # read as pages, for the titles asked, and for those known
    titles = pages.groupBy("doc").agg(F.coalesce(F.min_by("name", F.when(F.col("name").isNotNull(), F.col("page"))), F.lit("quite unknown")).alias("title"))
    targets = titles.join(t.orders.select(F.col("o_orderkey").alias("doc"), (F.col("o_orderstatus") == "F").alias("single")), "doc")
    found = match_sections(pages, targets, pages.select("doc", F.col("name").alias("title")))
    return found.withColumn("pages", F.concat_ws(",", F.col("pages").cast("array<string>")))


def _row(*cells) -> Column:
    """A table row: each cell a text, or (attributes, text)."""
    parts = [(F.lit("<td>"), c) if not isinstance(c, tuple) else (F.concat(F.lit("<td "), F.lit(c[0]), F.lit(">")), c[1]) for c in cells]
    return F.concat(F.lit("<tr>"), *[x for tag, text in parts for x in (tag, text.cast("string"), F.lit("</td>"))], F.lit("</tr>"))


def _pages_of(t, row, wrap=("<table>", "</table>")) -> DataFrame:
    """A page for each order: its items' rows in order, in a table (or what wrap says)."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("r", row.alias("row")))), lambda x: x["row"])
    head, tail = (F.first(w) if isinstance(w, Column) else F.lit(w) for w in wrap)
    return t.groupBy("l_orderkey").agg(F.concat(head, F.array_join(rows, ""), tail).alias("html"))


# Each item a row of an outer table, its second cell holding a table of its own and a text behind it.
@query("o_r6_nested_tables", f"""WITH items AS ({_ITEMS}), outer_cells AS (
  SELECT l_orderkey, 0 AS table_no, NULL::INTEGER AS parent_table, NULL::INTEGER AS parent_row, NULL::INTEGER AS parent_cell, CAST(r - 1 AS INTEGER) AS row_no, c AS cell_no, c AS col_no,
    CASE c WHEN 0 THEN CAST(l_partkey AS VARCHAR) WHEN 1 THEN concat(l_returnflag, ' ', l_linestatus, ' behind') ELSE 'last' END AS text FROM items, (VALUES (0), (1), (2)) v(c)
), inner_cells AS (
  SELECT l_orderkey, CAST(r AS INTEGER), 0, CAST(r - 1 AS INTEGER), 1, 0, c, c, CASE c WHEN 0 THEN l_returnflag ELSE l_linestatus END FROM items, (VALUES (0), (1)) v(c)
) SELECT * FROM outer_cells UNION ALL SELECT * FROM inner_cells""")
def nested_tables(t):
    inner = F.concat(F.lit("<table><tr><td>"), "l_returnflag", F.lit("</td> <td>"), "l_linestatus", F.lit("</td></tr></table> behind<script>var x = 1</script>"))
    return table_cells(_pages_of(_items(t), _row(F.col("l_partkey"), inner, F.lit("last"))), "l_orderkey").select("l_orderkey", "table_no", "parent_table", "parent_row", "parent_cell", "row_no", "cell_no", "col_no", "text")


# Each item two rows: a part over both, then flag and state one below the other, so the second row's only cell stands in column 1.
@query("o_r3_span_fill", f"""WITH items AS ({_ITEMS})
SELECT l_orderkey, CAST(2 * (r - 1) + i AS INTEGER) AS row_no, c AS col_no, CASE WHEN c = 0 THEN CAST(l_partkey AS VARCHAR) WHEN c = 1 AND i = 0 THEN l_returnflag WHEN c = 1 THEN l_linestatus ELSE concat('n', r) END AS text
FROM items, (VALUES (0), (1)) s(i), (VALUES (0), (1), (2), (3)) v(c)""")
def span_fill(t):
    two = F.concat(_row(("rowspan=2", F.col("l_partkey")), F.col("l_returnflag"), ('rowspan="2" colspan="2"', F.concat(F.lit("n"), F.col("r").cast("string")))), _row(F.col("l_linestatus")))
    return page_grids(_pages_of(_items(t), two), "l_orderkey").select("l_orderkey", "row_no", "col_no", "text")


# Each order a plan's session table.  By its priority the columns stand in one order (1) or another (2), the header has two rows (3), there is none (4), or a session has two rows (5).
@query("o_r4_session_rows", f"""WITH items AS ({_ITEMS})
SELECT l_orderkey, CAST(r AS INTEGER) AS session, CASE WHEN k IN ('1', '2', '4') THEN concat(month(l_shipdate), '/', day(l_shipdate)) END AS date,
  CASE WHEN k = '5' THEN concat('item ', l_partkey, chr(10), 'goes on ', l_linestatus) ELSE concat('item ', l_partkey) END AS content, CASE WHEN k IN ('1', '2', '3') THEN l_returnflag END AS note, CASE WHEN k = '4' THEN l_returnflag END AS materials
FROM items JOIN (SELECT o_orderkey, left(o_orderpriority, 1) AS k FROM orders) ON o_orderkey = l_orderkey""")
def session_rows(t):
    items = _items(t).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.substring("o_orderpriority", 1, 1).alias("k")), "l_orderkey")
    date = F.concat_ws("/", F.month("l_shipdate").cast("string"), F.dayofmonth("l_shipdate").cast("string"))
    r, content, k = F.col("r").cast("string"), F.concat(F.lit("item "), F.col("l_partkey").cast("string")), F.col("k")
    first, second = _row(F.concat(r, F.lit("회차")), date, content, F.col("l_returnflag")), _row(content, F.col("l_returnflag"), F.concat(r, F.lit(" "), date))
    row = F.when(k == "1", first).when(k == "2", second).when(k == "3", _row(r, F.lit("x"), content, F.col("l_returnflag"))).when(k == "4", _row(r, date, content, F.col("l_returnflag")))
    row = row.otherwise(F.concat(_row(("rowspan=1", r), content), _row(F.lit(""), F.concat(F.lit("goes on "), F.col("l_linestatus")))))
    names = {"1": ("차 시", "일자", "세부 교육내용", "비고"), "2": ("교육 내용", "비고", "차시(60분)"), "5": ("회차", "활동")}
    head = F.lit("<table>")
    for kind, labels in names.items():
        head = F.when(k == kind, F.concat(F.lit("<table><tr>"), F.lit("".join(f"<th>{x}</th>" for x in labels)), F.lit("</tr>"))).otherwise(head)
    head = F.when(k == "3", F.lit("<table><tr><th rowspan=2>차시</th><th colspan=2>수업</th><th>기타</th></tr><tr><th>방법</th><th>교육내용</th><th>비고</th></tr>")).otherwise(head)
    rows = page_rows(_pages_of(items.withColumn("head", head), row, (F.col("head"), "</table>")), "l_orderkey")
    return sessions_of_rows(rows, "l_orderkey").select("l_orderkey", "session", "date", "content", "note", "materials")


@query("o_x41_spacing", "SELECT doc_id, replace(text, '교재필기구', '교재·필기구') AS text FROM (SELECT doc_id, concat(doc_id, '과 교재·필기구, ', lang, ', 1,000') AS text FROM documents)")
def spacing(t):
    return t.documents.select("doc_id", X.spacing_repaired(F.concat(F.col("doc_id").cast("string"), F.lit("과교재필기구 ,"), "lang", F.lit(",  1,000"))).alias("text"))


# Each order an image of four lines an item: a title (taller, if flagged N), a time (if the state is O), a plain line and a contact.
@query("o_k17_segments", f"""WITH items AS ({_ITEMS}), lines AS (
  SELECT l_orderkey, 4 * r + i AS line, CASE WHEN i = 0 AND l_returnflag = 'N' THEN 24 ELSE 12 END AS height, i = 1 AND l_linestatus = 'O' AS meta, i = 0 AS titled, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS linked
  FROM items JOIN orders ON o_orderkey = l_orderkey, (VALUES (0), (1), (2), (3)) v(i)
), medians AS (SELECT l_orderkey, list_sort(list(height))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM lines GROUP BY 1),
anchors AS (
  SELECT *, CASE WHEN titled AND height >= 1.1 * median AND coalesce(bool_or(meta) OVER (PARTITION BY l_orderkey ORDER BY line ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), FALSE) THEN 1 ELSE 0 END AS anchor
  FROM lines JOIN medians USING (l_orderkey)
), counted AS (SELECT *, sum(anchor) OVER (PARTITION BY l_orderkey) AS n, sum(anchor) OVER (PARTITION BY l_orderkey ORDER BY line) AS seen FROM anchors)
SELECT l_orderkey, CAST(line AS INTEGER) AS line, CASE WHEN linked = 1 OR n < 2 THEN 0 ELSE CAST(least(seen, linked + 1) - 1 AS INTEGER) END AS segment, CASE WHEN linked = 1 OR n < 2 THEN 'WHOLE_DOCUMENT' ELSE 'PROGRAM_REGION' END AS kind
FROM counted WHERE linked = 1 OR n < 2 OR seen > 0""")
def image_segments(t):
    items = _items(t).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("linked")), "l_orderkey")
    line = lambda text, height=12: F.struct((text if isinstance(text, Column) else F.lit(text)).alias("text"), (height if isinstance(height, Column) else F.lit(height)).alias("height"))
    title = line(F.concat(F.lit("item "), F.col("l_partkey").cast("string")), F.when(F.col("l_returnflag") == "N", 24).otherwise(12))
    lines = F.array(title, line(F.when(F.col("l_linestatus") == "O", "일시 3/4").otherwise("no time")), line("plain words"), line("문의 도서관"))
    lines = items.select("l_orderkey", "linked", "r", F.posexplode(lines).alias("i", "x")).select("l_orderkey", "linked", (4 * F.col("r") + F.col("i")).cast("int").alias("line"), "x.text", "x.height")
    return title_segments(lines, "l_orderkey")
