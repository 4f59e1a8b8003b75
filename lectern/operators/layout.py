"""Reading order and tables from text boxes with places (left, top, right, bottom), one group of boxes a page.

Lines are found by one scan in order; columns, header cells and the rows of a
table under a header are windows and page-wise joins over the boxes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of the columns of a session table, as they stand in scanned plans.
COLUMN_LABEL = "^(?:차시|회차|회기|시수)$"
SESSION_LABEL = "^(?:차시|회차|회기|시수|일시|일자|교육일시|교육일자|강의일시|날짜|연번|순번|번호)$"
SESSION_OPENING = "^(?:차시|회차|회기|시수|일시|일자|연번|순번|번호)"
CONTENT_LABEL = "(?:내용|활동|주제|동화명|도서명|프로그램명|세부사항|강의명|수업명)"
CATEGORY_LABEL = "^(?:주제|분류|구분)$"
FOOTERS = (r"(?U)^\s*(?:작성자|작성일|문의|연락처)", r"(?U)^\s*[0-9]{4}\s*[년.]\s*[0-9]{1,2}\s*[월.]", r"(?U)(?:귀하|드림|올림)\s*$", r"(?U)작은도서관\s*귀하|평생교육과")
NUMBERED = r"^([0-9]{1,2})(?:회차|차시|회기|주차|시수|주|회|차)?(?:\(([^)]{2,12})\))?$"
DATED = r"^([0-9]{1,2})(?:[./-]|월)([0-9]{1,2})(?:일)?\.?(?:\([^)]*\))?$"
LEADING = r"(?U)^\s*([0-9]{1,2})\s*(?:회차|차시|주차|주)?\s*[.)]?\s+(.*)$"

FAR = 1e300


def _names(pattern: str) -> list[str]:
    """The names that a pattern of names lists."""
    return pattern[pattern.index("(?:") + 3 : pattern.rindex(")")].split("|")


def _pieces(names: list[str], cut: Callable[[str, int], str], least: int, less: int) -> str:
    """A pattern of the beginnings (or ends) of names, of ``least`` characters or more, that leave out ``less`` or more."""
    return "(?:" + "|".join(sorted({cut(n, k) for n in names for k in range(least, len(n) - less + 1)}, key=lambda x: (-len(x), x))) + ")"


# What one box must show for its line to name a column, if names may be torn over boxes: the session column's is the first thing in its cell (but for brackets) ...
_SESSION_NAMES, _CONTENT_NAMES = [*_names(SESSION_LABEL), *_names(SESSION_OPENING)], _names(CONTENT_LABEL)
MAY_NAME_SESSIONS = rf"\(|{SESSION_OPENING}|^{_pieces(_SESSION_NAMES, lambda n, k: n[:k], 1, 0)}$"
# ... and a content column's is whole in one box, or begins at the end of one and ends at the beginning of another.
CONTENT_BEGINS = rf"{_pieces(_CONTENT_NAMES, lambda n, k: n[:k], 1, 1)}$"
CONTENT_ENDS = rf"^{_pieces(_CONTENT_NAMES, lambda n, k: n[-k:], 1, 1)}"
# All those names are in Hangul.
NAME_LETTER = "[(가-힣]"


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def _centre(low: str, high: str) -> Column:
    return (F.col(low) + F.col(high)) / 2


def upper_median(value: str, by: list[str]) -> Column:
    """The upper median of a column over each group, from the counts of its different values: no sort of its own."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC) OVER (PARTITION BY {', '.join(f'`{c}`' for c in by)})")


def with_lines(boxes: DataFrame, by: list[str], ratio: float = 0.5, dealt_by: list[str] | None = None) -> DataFrame:
    """boxes and ``line``, the number of the line on its page (from 0, downwards) that each belongs to.

    In order of their tops (then lefts), a box joins the first line whose middle is
    within ``ratio`` of the page's upper median height (at least 4) of its own, and
    widens it.  A line's first box has its least top, so lines are numbered as they
    begin.  Boxes of a null group, or without a place, are left out.
    dealt_by: those of ``by`` that tasks are dealt pages by, for boxes that lie so already.
    """
    fit = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*by, "left", "top", "right", "bottom")])
    order = [F.asc("top"), F.asc("left"), F.asc("right"), F.asc("text")]
    # One shuffle and one sort: rows sorted for the scan are in order for the windows too, so the second sort is left out of the plan.
    dealt = boxes.filter(fit).repartition(*(dealt_by or by)).sortWithinPartitions(*by, *order)
    tall = dealt.withColumn("_tall", F.greatest(F.lit(1.0), (F.col("bottom") - F.col("top")).cast("double"))).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    near = F.greatest(F.lit(4.0), upper_median("_tall", by) * ratio)
    # Places that are doubles go to the workers once.
    double = {c: c if boxes.schema[c].dataType == T.DoubleType() else f"_{c}" for c in ("top", "bottom")}
    ready = tall.select(*boxes.columns, "_n", near.alias("_near"), *(F.col(c).cast("double").alias(d) for c, d in double.items() if c != d)).sortWithinPartitions(*by, *order)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in boxes.schema), "line int"])
    names = boxes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: list[float] = []  # of the page's lines, as their bottoms and middles
        bottoms: list[float] = []
        middles: list[float] = []
        left = 0  # boxes of the page that are still to come
        for batch in batches:
            made = []
            for n, top, bottom, near in zip(*(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("_n", double["top"], double["bottom"], "_near")), strict=True):
                if not left:
                    left, tops, bottoms, middles = n, [], [], []
                left -= 1
                middle = (top + bottom) / 2
                for k, m in enumerate(middles):  # noqa: B007
                    if abs(m - middle) <= near:
                        if top < tops[k] or bottom > bottoms[k]:
                            tops[k], bottoms[k] = min(top, tops[k]), max(bottom, bottoms[k])
                            middles[k] = (tops[k] + bottoms[k]) / 2
                        break
                else:
                    k = len(middles)
                    tops.append(top)
                    bottoms.append(bottom)
                    middles.append(middle)
                made.append(k)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(made, pa.int32())], names=[*names, "line"])

    return ready.mapInArrow(run, schema)


def line_texts(boxes: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """by, line, text (and more aggregates): the boxes of with_lines joined from left to right, blanks collapsed."""
    parts = F.array_sort(F.collect_list(F.struct("left", "top", "text")))
    text = F.trim(F.regexp_replace(F.array_join(F.transform(parts, lambda p: p["text"]), " "), r"(?U)\s{2,}", " "))
    return boxes.groupBy(*by, "line").agg(text.alias("text"), *more)


def boxes_to_lines(boxes: DataFrame, key: str, ratio: float = 0.5) -> DataFrame:
    """key, line, text of the lines of each page, from the top."""
    return line_texts(with_lines(boxes.select(key, "left", "top", "right", "bottom", "text"), [key], ratio), [key])


def split_columns(boxes: DataFrame, key: str, gap: float = 0.04, least: int = 8) -> DataFrame:
    """boxes and ``col``, the number of the column of text (from 0, from the left) that each box stands in.

    Where a line repeats the name of a session column, columns begin at its second
    and later ones, if boxes then stand in more than one.  Elsewhere the page is
    split in the middle of every gap that no box reaches into, of at least ``gap``
    of its width (and 12); pages of fewer than ``least`` boxes are one column.
    Boxes whose middle lies on the right end of the last column are left out, as
    are those that with_lines leaves out.
    """
    page = Window.partitionBy(key)
    # One shuffle and one sort by (left, right) serve every window.
    dealt = with_lines(boxes, [key]).repartition(key).withColumn("_mid", _centre("left", "right"))
    reach = F.max("right").over(Window.partitionBy(key).orderBy("left", "right").rowsBetween(Window.unboundedPreceding, -1)).cast("double")
    lined = dealt.withColumn("_reach", reach)
    lined = lined.withColumn("_from", F.min("left").over(page).cast("double")).withColumn("_to", F.max("right").over(page).cast("double")).withColumn("_n", F.count("*").over(page))
    # Names of session columns: the first line that has two of them.
    name = F.when(_bare(F.col("text")).rlike(COLUMN_LABEL), F.struct("line", F.col("left").cast("double").alias("left")))
    # Gaps: where the next box begins far behind everything before it.
    wide = F.col("left") - F.col("_reach") >= F.greatest(F.lit(12.0), (F.col("_to") - F.col("_from")) * gap)
    lined = lined.withColumn("_name", name).withColumn("_cut", F.when(wide & (F.col("_n") >= least), (F.col("_reach") + F.col("left")) / 2))
    placed = lined.withColumn("_named", F.array_sort(F.collect_list("_name").over(page))).withColumn("_cuts", F.collect_list("_cut").over(page))
    twice = F.filter("_named", lambda x, i: x["line"] == F.get(F.col("_named"), i + 1)["line"])
    first = F.get(twice, F.lit(0))["line"]
    names = F.transform(F.filter("_named", lambda x: x["line"] == F.col("_first")), lambda x: x["left"])
    placed = placed.withColumn("_first", F.when(F.size("_named") >= 2, first)).withColumn("_names", F.when(F.col("_first").isNotNull(), F.slice(names, 2, 1_000_000)))
    at = lambda cuts: F.size(F.filter(cuts, lambda c: c <= F.col("_mid")))
    placed = placed.withColumn("_by_name", F.when(F.col("_names").isNotNull(), at("_names"))).withColumn("_by_gap", at("_cuts"))
    several = F.coalesce(F.min("_by_name").over(page) < F.max("_by_name").over(page), F.lit(False))
    # With gaps the last column ends before the page's right end; without, all boxes are in one.
    inside = F.when(several, F.lit(True)).otherwise((F.size("_cuts") == 0) | (F.col("_mid") < F.col("_to")))
    placed = placed.withColumn("_col", F.when(several, F.col("_by_name")).otherwise(F.col("_by_gap"))).withColumn("_in", inside).filter("_in")
    ranked = placed.withColumn("_cols", F.collect_set("_col").over(page)).withColumn("col", F.size(F.filter("_cols", lambda c: c < F.col("_col"))).cast("int"))
    return ranked.select(*boxes.columns, "col")


def column_sessions(boxes: DataFrame, key: str) -> DataFrame:
    """key, col, at, session, activity: the numbered lines of each column, lines without a number going on from the one before.

    A number from 1 to 40 opens a session; what stands before the first one in a
    column, and sessions without any text, are left out.
    """
    by = [key, "col"]
    lines = line_texts(with_lines(split_columns(boxes, key), by).repartition(*by), by).filter("text <> ''")
    number = F.regexp_extract("text", LEADING, 1).try_cast("int")
    opens = F.coalesce(number.between(1, 40), F.lit(False))
    order = Window.partitionBy(*by).orderBy("line")
    lines = lines.withColumn("_opens", opens).withColumn("_number", F.when(opens, number)).withColumn("at", F.sum(F.col("_opens").cast("int")).over(order).cast("int"))
    part = F.when(F.col("_opens"), F.trim(F.regexp_extract("text", LEADING, 2))).otherwise(F.col("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line", part.alias("part")))), lambda p: p["part"])
    joined = F.array_join(F.filter(parts, lambda p: p != ""), "\n")
    found = lines.filter("at > 0").groupBy(*by, "at").agg(F.max("_number").alias("session"), joined.alias("activity"))
    return found.filter("activity <> ''")


def _mark_text(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_bare(text), "^[lI|]$", "1"), "^[oO]$", "0")


def _mark_parts(bare: Column) -> dict[str, Column]:
    # What does not match is null before it is cast: a cast that fails makes an error for each row.
    found = lambda pattern, group: F.nullif(F.regexp_extract(bare, pattern, group), F.lit(""))
    return {"number": found(NUMBERED, 1).try_cast("int"), "of": found(NUMBERED, 2), "month": found(DATED, 1).try_cast("int"), "day": found(DATED, 2).try_cast("int")}


def _mark(number: Column, of: Column, month: Column, day: Column) -> Column:
    as_number = F.when(number.between(1, 40), F.struct(number.alias("session"), of.alias("date")))
    spoken = F.concat_ws("/", month.cast("string"), day.cast("string"))
    as_date = F.when(month.between(1, 12) & day.between(1, 31), F.struct(F.lit(None).cast("int").alias("session"), spoken.alias("date")))
    return F.coalesce(as_number, as_date)


def session_mark(text: Column) -> Column:
    """struct(session, date) of a cell that names a session or its date, null for any other; l, I, | and O, o alone are digits."""
    return _mark(**_mark_parts(_mark_text(text)))


def header_cells(lined: DataFrame, on: list[str]) -> DataFrame:
    """on, cell, left, right, text, parts, boxes: the boxes of each group where the next one begins within 1.2 of the group's upper median height (at least 8).

    text is without blanks, parts is an array of (left, top, right, text without
    blanks) from the left, boxes the cell's boxes as they are.
    """
    order = Window.partitionBy(*on).orderBy("left", "top", "text")
    reach = F.max("right").over(order.rowsBetween(Window.unboundedPreceding, -1))
    sized = lined.withColumn("_reach", reach).withColumn("_h", F.greatest(F.lit(1.0), (F.col("bottom") - F.col("top")).cast("double"))).withColumn("_tall", upper_median("_h", on))
    breaks = F.when(F.col("left") - F.col("_reach") <= F.greatest(F.lit(8.0), F.col("_tall") * 1.2), 0).otherwise(1)
    grouped = sized.withColumn("_new", breaks).withColumn("cell", F.sum("_new").over(order)).withColumn("_bare", _bare(F.col("text")))
    # A cell's first box stands for it: windows in order take fewer sorts than groups of arrays.
    from_left = Window.partitionBy(*on, "cell").orderBy("left", "top", "right", "_bare")
    every = from_left.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    part = F.struct(F.col("left").cast("double").alias("left"), F.col("top"), F.col("right").cast("double").alias("right"), F.col("_bare").alias("text"))
    ends = (F.min("left").over(every).cast("double").alias("left"), F.max("right").over(every).cast("double").alias("right"))
    arrays = (F.collect_list(part).over(every).alias("parts"), F.collect_list(F.struct("left", "top", "right", "bottom", "text")).over(every).alias("boxes"))
    cells = grouped.select(*on, "cell", *ends, *arrays, F.row_number().over(from_left).alias("_nth")).filter("_nth = 1")
    return cells.select(*on, "cell", "left", "right", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), "parts", "boxes")


def _is_session(text: Column) -> Column:
    bare = F.regexp_replace(text, r"\([^)]*\)", "")
    return bare.rlike(SESSION_LABEL) | bare.rlike(SESSION_OPENING)


def _may_be_header(lined: DataFrame, key: str) -> DataFrame:
    """The boxes of lines that may name a session or a content column, with a name of the other there or on a line beside it.

    Told by each box for itself, so few lines but headers are left to be read as cells.
    """
    line, near = Window.partitionBy(key, "line"), Window.partitionBy(key).orderBy("line").rangeBetween(-1, 1)
    # What a box shows, and then its line and the lines beside it, as bits: a session name, a content name, its beginning, its end.
    seen = lined.sortWithinPartitions(key, "line").withColumn("_bare", F.when(F.col("text").rlike(NAME_LETTER), _bare(F.col("text"))))
    bits = [F.when(F.col("_bare").rlike(p), 1 << k).otherwise(0) for k, p in enumerate((MAY_NAME_SESSIONS, CONTENT_LABEL, CONTENT_BEGINS, CONTENT_ENDS))]
    shown = F.when(F.col("_bare").isNotNull(), reduce(lambda a, b: a.bitwiseOR(b), bits)).otherwise(0)
    told = seen.withColumn("_shown", shown).withColumn("_line", F.bit_or("_shown").over(line))
    content = (F.col("_line").bitwiseAND(2) > 0) | (F.col("_line").bitwiseAND(12) == 12)
    told = told.select(*lined.columns, F.col("_line").bitwiseAND(1).bitwiseOR(F.when(content, 2).otherwise(0)).alias("_names"))
    told = told.withColumn("_near", F.bit_or("_names").over(near))
    return told.filter("_names > 0 AND _near = 3").select(*lined.columns)


def _header_lines(lined: DataFrame, key: str) -> DataFrame:
    """key, head and the header_cells of every line that names a session column and a content column, by itself or with the next line's names."""
    cells = header_cells(_may_be_header(lined, key), [key, "line"])
    along = Window.partitionBy(key, "line").orderBy("cell")
    every = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = F.bool_or(_is_session(F.col("text"))).over(every).alias("s"), F.bool_or(F.col("text").rlike(CONTENT_LABEL)).over(every).alias("c")
    kinds = cells.select(key, "line", *named, F.flatten(F.collect_list("boxes").over(every)).alias("boxes"), F.row_number().over(along).alias("_nth")).filter("_nth = 1").drop("_nth")
    order = Window.partitionBy(key).orderBy("line")
    below = F.lead(F.struct("line", "s", "c", "boxes")).over(order)
    pairs = kinds.withColumn("below", below)
    two = F.col("s") & ~F.col("c") & F.coalesce((F.col("below.line") == F.col("line") + 1) & F.col("below.c") & ~F.col("below.s"), F.lit(False))
    heads = pairs.withColumn("two", two).filter("s AND (c OR two)")
    boxes = F.when(F.col("two"), F.concat("boxes", "below.boxes")).otherwise(F.col("boxes"))
    return header_cells(heads.select(key, F.col("line").alias("head"), F.inline(boxes)), [key, "head"])


def _grid(cells: DataFrame, key: str) -> DataFrame:
    """key, head and the bounds of its session, content and category columns, from the cells of header lines.

    Each step is a window over a header's cells: as one expression over an array of
    them, every bound would hold the whole search for its cell again, and the driver
    could not hold the plan.
    """
    on = [key, "head"]
    order, whole = Window.partitionBy(*on).orderBy("left", "right", "text", "parts"), Window.partitionBy(*on)
    before, after = F.lag("right").over(order), F.lead("left").over(order)
    edges = (F.coalesce((before + F.col("left")) / 2, F.lit(-FAR)).alias("low"), F.coalesce((F.col("right") + after) / 2, F.lit(FAR)).alias("high"), before.alias("before"))
    bottom = F.array_max(F.transform("boxes", lambda b: b["bottom"])).cast("double")
    parts = F.col("parts")
    narrow = F.when((F.size(parts) > 1) & F.get(parts, F.lit(0))["text"].rlike(SESSION_LABEL), (F.get(parts, F.lit(0))["right"] + F.get(parts, F.lit(1))["left"]) / 2)
    names = (_is_session(F.col("text")).alias("session"), F.col("text").rlike(CONTENT_LABEL).alias("content"), F.col("text").rlike(CATEGORY_LABEL).alias("category"))
    rows = cells.select(*on, "left", F.row_number().over(order).alias("i"), *edges, bottom.alias("bottom"), narrow.alias("narrow"), *names)
    i, s, c, k = (F.col(x) for x in ("i", "s", "c", "k"))
    rows = rows.withColumn("s", F.min(F.when(F.col("session"), i)).over(whole))
    last = lambda rule: F.max(F.when(rule, i)).over(whole)
    plain = F.col("content") & ~F.col("category")
    rows = rows.withColumn("c", F.coalesce(last(plain & (i > s)), last(plain & (i < s)), last(F.col("content") & (i != s)))).filter("c IS NOT NULL")
    rows = rows.withColumn("k", F.min(F.when(F.col("category") & (i > s) & (i < c), i)).over(whole))
    at = lambda cell, what: F.max(F.when(i == cell, F.col(what)))
    return rows.groupBy(*on).agg(
        F.max("bottom").alias("bottom_of"), F.max(c > s).alias("content_right"), at(s, "narrow").alias("narrow"), at(s, "low").alias("session_from"), F.coalesce(at(s, "narrow"), at(s, "high")).alias("session_to"), at(c, "low").alias("content_from"),
        at(c, "high").alias("content_to"), at(c, "before").alias("before_content"), at(k, "low").alias("category_from"), at(k, "high").alias("category_to"), F.min("left").alias("leftmost"),
    )


def header_grid(boxes: DataFrame, key: str) -> DataFrame:
    """key, at, session, date, activity: the rows of the session table of each page, by the places of its header.

    A header line names a session column and a content column (or its next line
    does the latter).  Cells in the session column that read as numbers or dates
    mark the rows; a row's band ends halfway to the next mark; what stands in the
    content column in its band is its activity, after what stands in a category
    column between the two; closing lines (writers, dates, addresses) are dropped.
    Of several header lines the first with two rows or more counts, else the first.
    """
    # Boxes are dealt by their page once they have lines, and once more after the lines of the bands; all between is windows on that.
    # Both readers of the boxes ask for no less than this filter, so that they share one shuffle.
    here = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (key, "line")])
    lined = with_lines(boxes.select(key, "left", "top", "right", "bottom", "text"), [key]).filter(here).repartition(key)
    on = [key, "head"]
    grids = _grid(_header_lines(lined, key), key)
    # Where no header line has two rows, the first header line's are taken, if it has any.
    grids = grids.withColumn("_first", F.min("head").over(Window.partitionBy(key)))
    # What the places alone tell, at the join: where a mark may stand (three ways to look, the first that has any counts), and which column it is.
    x, content_right = _centre("left", "right"), F.col("content_right")
    after = x >= F.col("session_from")
    way = F.when(after & (x < F.col("session_to")), 1).when(content_right & F.col("narrow").isNull() & after & (x < F.greatest("session_to", "content_from")), 2).when(F.col("right") <= F.col("leftmost"), 3)
    # Content goes on from the marks' end too, but for a column left of the session column that ends before it.
    begins = F.when(content_right, F.coalesce(F.col("before_content") + 2, F.lit(-FAR))).otherwise(F.col("content_from"))
    content = (x >= begins) & (x < F.col("content_to"))
    category = F.coalesce((x >= F.col("category_from")) & (x < F.col("category_to")), F.lit(False))
    body = lined.join(grids, key).filter(F.col("line") > F.col("head"))
    body = body.select(*on, "_first", "left", "top", "right", "bottom", "text", "bottom_of", F.when(~content_right, F.col("content_to")).alias("_until"), way.alias("_way"), content.alias("_content"), category.alias("_category"))
    # One sort for all windows up to the bands.
    body = body.filter("_way IS NOT NULL OR _content OR _category").sortWithinPartitions(*on, "top", "left", "text")
    # A mark begins with a digit, or with a letter that is read as one.
    may_mark = F.col("_way").isNotNull() & F.col("text").rlike(r"(?U)^\s*[0-9lI|]") & ((F.col("_way") < 3) | F.trim("text").rlike("^[0-9]{1,2}$"))
    # session_mark in steps, so that its code holds each pattern once and the virtual machine compiles it.
    body = body.withColumn("_bare", F.when(may_mark, _mark_text(F.col("text"))))
    told = _mark_parts(F.col("_bare"))
    body = body.withColumns(told).withColumn("mark", _mark(**{c: F.col(c) for c in told})).drop("_bare", *told)
    body = body.withColumn("_way", F.when(F.col("mark").isNotNull(), F.col("_way")))
    group, order = Window.partitionBy(*on), Window.partitionBy(*on).orderBy("top", "left", "text")
    numbered, dated = F.col("mark.session").isNotNull(), F.col("mark.session").isNull()
    body = body.withColumn("_seen", F.coalesce(F.col("_way") == F.min("_way").over(group), F.lit(False)))
    mixed = F.min(F.when(F.col("_seen") & dated, F.col("left"))).over(group) < F.max(F.when(F.col("_seen") & numbered, F.col("right"))).over(group)
    body = body.withColumn("_is_mark", F.col("_seen") & (numbered | ~F.coalesce(mixed, F.lit(False))))
    of_marks = lambda c: F.when(F.col("_is_mark"), c)
    above = F.last(of_marks(F.col("bottom")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    count = F.count(of_marks(F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    ends, all_numbered = F.max(of_marks(F.col("right"))).over(group), F.min(of_marks(numbered)).over(group)
    body = body.select("*", above.alias("_above"), count.alias("_at"), (ends + 2).cast("double").alias("marks_end"), all_numbered.alias("_all")).filter("marks_end IS NOT NULL")
    content = F.col("_content") & ((_centre("left", "right") >= F.col("marks_end")) | F.coalesce(F.col("marks_end") >= F.col("_until"), F.lit(False)))
    # A box may mark a row, stand in its content and in its category: a row for each, marks where their bands begin, and an as-of step down the page.
    band = F.when(F.col("_at") == 1, F.col("bottom_of")).otherwise((F.col("_above") + F.col("top")) / 2)
    mark = F.struct(F.col("_at").alias("at"), F.when(F.col("_all"), F.col("mark.session")).otherwise(F.col("_at")).alias("session"), F.col("mark.date").alias("date"))
    parts = body.select(*on, "_first", "left", "top", "right", "bottom", "text", "_is_mark", band.cast("double").alias("_band"), of_marks(mark).alias("mark"), content.alias("_content"), "_category")
    parts = parts.withColumn("what", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).filter("CASE what WHEN 0 THEN _is_mark WHEN 1 THEN _content ELSE _category END")
    is_band = F.col("what") == 0
    parts = parts.withColumn("_y", F.when(is_band, F.col("_band")).otherwise(_centre("top", "bottom").cast("double"))).withColumn("mark", F.when(is_band, F.col("mark")))
    down = Window.partitionBy(*on).orderBy("_y", "what", "mark.at").rowsBetween(Window.unboundedPreceding, 0)
    banded = parts.withColumn("mark", F.last("mark", ignorenulls=True).over(down)).filter("what > 0 AND mark IS NOT NULL")
    banded = banded.select(*on, "_first", "mark.at", "mark.session", "mark.date", "what", "left", "top", "right", "bottom", "text")
    inside = [*on, "at", "what"]
    # One sort for the texts of lines, of bands and the choice of a header; a group's first row stands for it.
    found = with_lines(banded, inside, dealt_by=[key]).repartition(key).sortWithinPartitions(*inside, "line", "left", "top", "text")
    in_line, in_band = Window.partitionBy(*inside, "line").orderBy("left", "top", "text"), Window.partitionBy(*on, "at").orderBy("what", "line")
    every = (Window.unboundedPreceding, Window.unboundedFollowing)
    lines = found.select("*", F.collect_list("text").over(in_line.rowsBetween(*every)).alias("_texts"), F.row_number().over(in_line).alias("_nth")).filter("_nth = 1")
    lines = lines.withColumn("text", F.trim(F.regexp_replace(F.array_join("_texts", " "), r"(?U)\s{2,}", " ")))
    footer = reduce(lambda a, b: a | b, [F.col("text").rlike(p) for p in FOOTERS])
    lines = lines.select(*on, "_first", "at", "session", "date", "what", "line", F.when((F.col("text") != "") & ((F.col("what") == 2) | ~footer), F.col("text")).alias("text"))
    texts = lambda what: F.collect_list(F.when(F.col("what") == what, F.col("text"))).over(in_band.rowsBetween(*every))
    rows = lines.select("*", texts(1).alias("content"), texts(2).alias("category"), F.row_number().over(in_band).alias("_nth")).filter("_nth = 1")
    rows = rows.withColumn("content", F.trim(F.array_join("content", "\n"))).withColumn("category", F.trim(F.array_join("category", " "))).filter("content <> ''")
    activity = F.concat_ws("\n", F.nullif("category", F.lit("")), "content")
    rows = rows.select(*on, "at", "session", "date", "_first", activity.alias("activity")).withColumn("_n", F.count("*").over(group))
    chosen = F.coalesce(F.min(F.when(F.col("_n") >= 2, F.col("head"))).over(Window.partitionBy(key)), F.col("_first"))
    return rows.withColumn("_head", chosen).filter("head = _head").select(key, "at", "session", "date", "activity")


def page_sessions(boxes: DataFrame, key: str) -> DataFrame:
    """key, session, date, activity: header_grid's rows where their numbers hold.

    Rows without a date go on from the row before where others have one.  Rows
    stand as they are if their sessions are 1, 2, ... without a gap; else those with
    a date are numbered in order; else the sessions that lead on from 1 stay, the
    first row of each, if they are two or more.
    """
    raw = header_grid(boxes, key)
    page, order = Window.partitionBy(key), Window.partitionBy(key).orderBy("at")
    has_date = F.col("date").isNotNull()
    both = F.coalesce(F.bool_or(has_date).over(page) & F.bool_or(~has_date).over(page), F.lit(False))
    part = F.when(both, F.sum(F.when(has_date | (F.row_number().over(order) == 1), 1).otherwise(0)).over(order)).otherwise(F.row_number().over(order))
    first = lambda c: F.min_by(c, "at").alias(c)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "activity"))), lambda x: x["activity"])
    rows = raw.withColumn("part", part).groupBy(key, "part").agg(first("session"), first("date"), F.trim(F.array_join(texts, "\n")).alias("activity"))
    by_part, by_session = Window.partitionBy(key).orderBy("part"), Window.partitionBy(key).orderBy("session", "part")
    repeat = F.row_number().over(Window.partitionBy(key, "session").orderBy("part")) > 1
    rows = rows.withColumn("again", repeat).withColumn("dense", F.dense_rank().over(by_session)).withColumn("dated", F.col("date").isNotNull())
    rows = rows.withColumn("sound", F.min((~F.col("again") & (F.col("session") == F.col("dense"))).cast("int")).over(page) == 1).withColumn("any_date", F.bool_or("dated").over(page))
    rows = rows.withColumn("by_date", F.sum(F.col("dated").cast("int")).over(by_part).cast("int"))
    leads = ~F.col("again") & (F.col("session") == F.col("dense"))
    rows = rows.withColumn("leads", leads).withColumn("n_leads", F.sum(leads.cast("int")).over(page))
    number = F.when(F.col("sound"), F.col("session")).when(F.col("any_date"), F.when(F.col("dated"), F.col("by_date"))).when(F.col("leads") & (F.col("n_leads") >= 2), F.col("session"))
    return rows.withColumn("session", number.cast("int")).filter("session IS NOT NULL").select(key, "session", "date", "activity")
