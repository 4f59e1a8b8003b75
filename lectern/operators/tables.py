"""Tables as grids, and the session rows of plan tables: spans filled, header rows found, columns told by their names or contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import activity_text, bound, spacing_repaired

# What plan tables call their columns.
SESSION_NAME = "(?i)^(?:차시|회차|회기|주|주차|일|시수|period|week)(?:날짜)?$"
CONTENT_NAME = "(?i)(?:교육내용|강의내용|수업계획|수업내용|세부교육내용|주제|활동|activity)"
CONTENT_COLUMN = "(?i)(?:교육내용|강의내용|수업계획|수업내용|세부교육내용|내용|활동|activity)"
MERGED_NAME = "(?:차시|회차|회기)"
DATE_NAME, TOPIC_NAME, NOTE_NAME, MATERIALS_NAME, METHOD_NAME = "^(?:일자.*|날짜)$", "^주제$", "(?:준비물|비고)$", "^준비물$", "^교수방법(?:준비물)?$"
UNIT = r"(?U)(?s)^(.*?[0-9]{1,2})\s*(?:회차|차시|회기|주차|시수|주)"
NAME_CHARS = 20
NUMBER, DAY = "^[0-9]{1,2}$", "^[0-9]{1,2}[./-][0-9]{1,2}$"


def table_grid(cells: DataFrame, key: str) -> DataFrame:
    """key, table_no, row_no, col_no, text, header: one row for each slot of each table's grid that a cell covers.

    A cell covers its spans from its col_no on, no further down than its table's
    last row.  Where cells overlap, the first non-empty text in reading order stands.
    """
    last = F.max("row_no").over(Window.partitionBy(key, "table_no"))
    to_row = F.least(F.col("row_no") + F.greatest(F.col("rowspan"), F.lit(1)) - 1, last)
    spread = cells.withColumn("_to", to_row).withColumn("r", F.explode(F.sequence("row_no", "_to")))
    spread = spread.withColumn("c", F.explode(F.sequence(F.col("col_no"), F.col("col_no") + F.greatest(F.col("colspan"), F.lit(1)) - 1)))
    filled = F.nullif(F.trim("text"), F.lit(""))
    at = F.struct(filled.isNull(), "row_no", "cell_no")
    return spread.groupBy(key, "table_no", F.col("r").alias("row_no"), F.col("c").alias("col_no")).agg(F.min_by(filled, at).alias("text"), F.bool_or("header").alias("header"))


def _compact(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def _session_name(text: Column) -> Column:
    return F.regexp_replace(_compact(text), r"\([^)]*\)$", "").rlike(SESSION_NAME)


def _content_name(text: Column) -> Column:
    return (F.length(_compact(text)) <= NAME_CHARS) & _compact(text).rlike(CONTENT_NAME)


def _both_names(text: Column) -> Column:
    bare = _compact(text)
    return (F.length(bare) <= 2 * NAME_CHARS) & bare.rlike(MERGED_NAME) & bare.rlike(CONTENT_NAME)


def _one_line(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, r"(?U)\s*\n\s*", " ")).otherwise(text)


def _clean(text: Column) -> Column:
    """A cell's text on one line."""
    return spacing_repaired(bound(F.coalesce(text, F.lit("")), _one_line))


def _with_plain(frame: DataFrame, **cells: Column) -> DataFrame:
    """frame with cells' texts on one line, without notices behind a reference mark; step by step, so that none is worked out twice."""
    frame = frame.withColumns(cells)
    for step in (
        _one_line, spacing_repaired,
        lambda t: F.trim(F.when(F.contains(t, F.lit("※")), F.regexp_replace(t, r"※[^※\n]*", "")).otherwise(t)),
    ):
        frame = frame.withColumns({c: step(F.col(c)) for c in cells})
    return frame


def _with_lines(frame: DataFrame, name: str, cell: Column) -> DataFrame:
    """frame with a cell's text line by line, without empty ones."""
    several = F.array_join(F.filter(F.transform(F.split(name, "\n"), lambda x: spacing_repaired(F.trim(x))), lambda x: x != ""), "\n")
    frame = frame.withColumn(name, F.coalesce(cell, F.lit(""))).withColumn("_alone", F.trim(name))
    return frame.withColumn(name, F.when(F.contains(name, F.lit("\n")), several).otherwise(spacing_repaired(F.col("_alone")))).drop("_alone")


def _number(text: Column) -> Column:
    return F.regexp_replace(text, UNIT, "$1")


ROLES = ("session", "content", "date", "topic", "note", "materials", "method", "category")
# A letter that every column's name has one of.
NAME_LETTER = "[가-힣dkyDKY]"


def _roles(head: Column, body: Column, at: dict[str, Column]) -> Column:
    """The header row (-1 without one), the last row above the body, and the column of each role (null where there is none)."""
    none = F.lit(None).cast("int")
    return F.struct(head.cast("int").alias("head"), body.cast("int").alias("body"), *(at.get(role, none).cast("int").alias(f"{role}_at") for role in ROLES))


def _roles_by_name(rows: DataFrame, every, order) -> DataFrame:
    """rows with the roles that the first row of their table gives which names its columns, alone or with the row below (named)."""
    told = rows.withColumn("_c_below", F.coalesce(F.lead("_c").over(order), F.lit(False))).withColumn("_lower", F.lead("cells").over(order)).withColumn("_row_below", F.lead("row_no").over(order))
    told = told.withColumn("_two", F.col("_s") & ~F.col("_c") & F.col("_c_below"))
    told = told.withColumn("_is_head", F.col("_m") | (F.col("_s") & F.col("_c")) | F.col("_two"))
    told = told.withColumn("_first", F.min(F.when(F.col("_is_head"), F.col("row_no"))).over(every)).withColumn("_is_head", F.col("row_no") == F.col("_first"))
    upper, lower = F.col("cells"), F.when(F.col("_two"), F.col("_lower"))
    name = lambda c: F.array_join(F.array_distinct(F.array_compact(F.array(_compact(F.try_element_at(upper, c)), _compact(F.try_element_at(lower, c))))), "")
    columns = F.array_sort(F.array_union(F.map_keys(upper), F.coalesce(F.map_keys(lower), F.array().cast("array<int>"))))
    told = told.withColumn("_names", F.when(F.col("_is_head"), F.transform(columns, lambda c: F.struct(c.alias("col"), name(c).alias("name")))))
    first = lambda test: F.try_element_at(F.transform(F.filter("_names", lambda n: test(n["name"])), lambda n: n["col"]), F.lit(1))
    both = first(_both_names)
    at = {"session": F.coalesce(both, first(_session_name)), "content": F.coalesce(both, first(lambda n: n.rlike(CONTENT_COLUMN + "$")), first(lambda n: n.rlike(CONTENT_COLUMN)))}
    for role, pattern in (("date", DATE_NAME), ("topic", TOPIC_NAME), ("note", NOTE_NAME), ("materials", MATERIALS_NAME), ("method", METHOD_NAME)):
        at[role] = first(lambda n, pattern=pattern: n.rlike(pattern))
    at["category"] = F.when(at["content"] - at["date"] > 1, at["date"] + 1)
    roles = F.when(F.col("_is_head"), _roles(F.col("row_no"), F.when(F.col("_two"), F.col("_row_below")).otherwise(F.col("row_no")), at))
    return told.withColumn("_named", roles).withColumn("named", F.first("_named", ignorenulls=True).over(every)).select(*rows.columns, "named")


def _roles_by_content(rows: DataFrame, every) -> DataFrame:
    """rows with the roles that a table without a header shows (shown): number, day, content, note; or a number in one of the first two columns and the longest text behind it."""
    bare = F.col("named").isNull()
    told = _with_plain(rows, **{f"_{c}": F.when(bare, F.try_element_at("cells", F.lit(c))) for c in (0, 1)})
    told = told.withColumn("_at", F.when(_number(F.col("_0")).rlike(NUMBER), 0).when(_number(F.col("_1")).rlike(NUMBER), 1))
    size = F.when(F.col("_0").rlike(NUMBER) & F.col("_1").rlike(DAY), F.size("cells"))
    told = told.withColumn("_size", size).withColumn("_size", F.first("_size", ignorenulls=True).over(every))
    told = told.withColumn("_first", F.min(F.when(F.col("_at").isNotNull(), F.col("row_no"))).over(every)).withColumn("_tells", F.col("row_no") == F.col("_first"))
    told = told.withColumn("_texts", F.when(F.col("_tells"), F.transform(F.array_sort(F.map_keys("cells")), lambda c: F.struct(c.alias("col"), _clean(F.try_element_at("cells", c)).alias("text")))))
    longest = F.array_max(F.transform(F.filter("_texts", lambda x: x["col"] > F.col("_at")), lambda x: F.struct(F.length(x["text"]).alias("n"), (-x["col"]).alias("c"))))
    own = F.length(F.array_max(F.transform(F.filter("_texts", lambda x: x["col"] == F.col("_at")), lambda x: x["text"])))
    told = told.withColumn("_longest", F.when(F.col("_tells"), longest)).withColumn("_content", F.when(F.col("_longest.n") > own, -F.col("_longest.c")))
    first = lambda test: F.try_element_at(F.transform(F.filter("_texts", test), lambda x: x["col"]), F.lit(1))
    note = first(lambda x: (x["col"] > F.col("_content")) & (x["text"] != ""))
    date = first(lambda x: (x["col"] > F.col("_at")) & (x["col"] < F.col("_content")) & x["text"].rlike(r"(?U)[0-9]{1,2}\s*[월./-]\s*[0-9]{1,2}"))
    none = F.lit(-1)
    told = told.withColumn("_any", F.when(F.col("_tells"), _roles(none, none, {"session": F.col("_at"), "content": F.col("_content"), "date": date, "note": note})))
    told = told.withColumn("_any", F.first("_any", ignorenulls=True).over(every))
    four = F.when(F.col("_size") >= 4, F.lit(3))
    by_day = _roles(none, none, {"session": F.lit(0), "content": F.lit(2), "date": F.lit(1), "note": four, "materials": four})
    shown = F.when(F.col("_size").isNotNull(), by_day).when(F.col("_any.content_at").isNotNull(), F.col("_any"))
    return told.withColumn("shown", F.when(bare, shown)).select(*rows.columns, "shown")


def session_table(grid: DataFrame, key: str) -> DataFrame:
    """session_rows of table_grid's slots."""
    rows = grid.groupBy(key, "table_no", "row_no").agg(F.map_from_entries(F.collect_list(F.struct(F.col("col_no").cast("int"), "text"))).alias("cells"))
    return session_rows(rows, key)


def session_rows(rows: DataFrame, key: str) -> DataFrame:
    """key, session, date, content, note, category, method, materials: the sessions of all tables of each key, from the rows of their grids.

    rows: key, table_no, row_no, cells (col_no to text).  A header row names a
    session and a content column, in any order and place, by itself or with the row
    below; without one the columns are told by what they hold.  Units and days
    beside a number are read off it, a number may also open the content; rows
    without a number go on from the one before; an empty category takes the one
    above it.  Sessions of one number are one: texts that are not yet held are
    added, other fields take the first.  Tables without such columns give no rows.

    One shuffle by key and windows on its order: roles are told in the row that
    shows them and carried over their table, and only cells with a role are read.
    """
    table = [key, "table_no"]
    order = Window.partitionBy(*table).orderBy("row_no")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    values = F.when(F.array_join(F.map_values("cells"), " ").rlike(NAME_LETTER), F.transform(F.filter(F.map_values("cells"), lambda x: x.rlike(NAME_LETTER)), _compact))
    has = lambda test: F.coalesce(F.exists("_values", test), F.lit(False))
    marked = rows.withColumn("_values", values).select(*table, "row_no", "cells", has(_both_names).alias("_m"), has(_session_name).alias("_s"), has(_content_name).alias("_c"))
    marked = marked.repartition(key).sortWithinPartitions(key, "table_no", "row_no")
    told = _roles_by_content(_roles_by_name(marked, every, order).drop("_m", "_s", "_c"), every)
    body = told.withColumn("_roles", F.coalesce("named", "shown")).select(*table, "row_no", "cells", "_roles.*").filter("(session_at IS NOT NULL OR content_at IS NOT NULL) AND row_no > body")
    cell = lambda at: F.try_element_at("cells", F.col(at) if isinstance(at, str) else at)
    counted = lambda c: F.coalesce(_number(F.col(c)).rlike(NUMBER), F.lit(False))
    body = _with_plain(body, _own=cell("session_at")).withColumn("_counted", F.bool_or(counted("_own")).over(every))
    body = _with_plain(body, _next=F.when((F.col("head") >= 0) & ~F.col("_counted"), cell(F.col("session_at") + 1))).withColumn("_moved", F.bool_or(counted("_next")).over(every))
    body = body.withColumn("_own", F.when(F.col("_moved"), F.col("_next")).otherwise(F.col("_own")))
    body = _with_lines(body, "text", cell("content_at")).withColumn("mark", _number(F.coalesce("_own", F.lit(""))))
    pair, bracket = r"(?U)^([0-9]{1,2})\s+([0-9]{1,2}[./-][0-9]{1,2})$", r"(?U)^([0-9]{1,2})\s*\(\s*([0-9]{1,2}\s*[./-]\s*[0-9]{1,2})\s*\)$"
    body = body.withColumn("day", F.when(F.col("mark").rlike(pair), F.regexp_extract("mark", pair, 2)).when(F.col("mark").rlike(bracket), _compact(F.regexp_extract("mark", bracket, 2))))
    body = body.withColumn("mark", F.when(F.col("mark").rlike(pair), F.regexp_extract("mark", pair, 1)).when(F.col("mark").rlike(bracket), F.regexp_extract("mark", bracket, 1)).otherwise(F.col("mark")))
    opens, within = r"(?U)(?s)^([0-9]{1,2})\s+(.+)", r"(?U)(?s)^(.*?\n\s*)([0-9]{1,2})\s+(?=\S)"
    open_, unread = F.col("mark").rlike(NUMBER), F.col("text") != ""
    found = F.when(open_, F.lit(0)).when(unread & F.col("text").rlike(opens), 1).when(unread & F.col("text").rlike(within), 2)
    body = body.withColumn("way", found)
    body = body.withColumn("mark", F.when(F.col("way") == 1, F.regexp_extract("text", opens, 1)).when(F.col("way") == 2, F.regexp_extract("text", within, 2)).otherwise(F.col("mark")))
    body = body.withColumn("text", F.when(F.col("way") == 1, F.regexp_extract("text", opens, 2)).when(F.col("way") == 2, F.trim(F.regexp_replace("text", within, "$1"))).otherwise(F.col("text")))
    more = F.col("way").isNull() & (F.col("mark") == "") & (F.col("text") != "") & ~F.startswith("text", F.lit("※"))
    kept = body.withColumn("more", more).filter("way IS NOT NULL OR more")
    order = Window.partitionBy(*table).orderBy("row_no")
    kept = kept.withColumn("part", F.sum(F.col("way").isNotNull().cast("int")).over(order)).filter("part > 0")
    others = ("date", "topic", "note", "materials", "method", "category")
    kept = _with_plain(kept, **{f"_{c}": cell(f"{c}_at") for c in others}).withColumns({f"_{c}": F.nullif(f"_{c}", F.lit("")) for c in others})
    kept = kept.withColumn("category", F.last("_category", ignorenulls=True).over(order))
    note = F.when(~F.coalesce(F.col("note_at") == F.col("materials_at"), F.lit(False)) & ~F.coalesce(F.col("note_at") == F.col("method_at"), F.lit(False)), F.col("_note"))
    fields = kept.select(*table, "part", "row_no", "way", F.col("mark").try_cast("int").alias("session"), F.coalesce("day", "_date").alias("date"), F.concat_ws("\n", "_topic", F.nullif("text", F.lit(""))).alias("text"), note.alias("note"), "category", F.col("_method").alias("method"), F.col("_materials").alias("materials"))
    # A part is its first row, which has the number, with the texts of those behind it.
    texts = F.collect_list("text").over(Window.partitionBy(*table, "part").orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    one = fields.withColumn("_texts", texts).filter("way IS NOT NULL").withColumn("content", F.array_join("_texts", "\n")).drop("_texts", "text")
    one = one.withColumn("content", activity_text(F.col("content")))
    same = Window.partitionBy(key, "session").orderBy("table_no", "row_no")
    all_same = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    joined, first = ("content", "note", "method", "materials"), ("date", "category")
    out = one.select(key, "session", F.row_number().over(same).alias("_n"), *(F.collect_list(F.nullif(c, F.lit(""))).over(all_same).alias(c) for c in joined), *(F.first(c, ignorenulls=True).over(all_same).alias(c) for c in first)).filter("_n = 1")

    def added(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(""), lambda s, x: F.when(s == "", x).when(F.contains(s, x), s).otherwise(activity_text(F.concat(s, F.lit("\n"), x))))

    for c in joined:
        out = out.withColumn(c, F.when(F.size(c) <= 1, F.get(c, F.lit(0))).otherwise(added(F.col(c))))
    return out.select(key, "session", "date", F.coalesce("content", F.lit("")).alias("content"), "note", "category", "method", "materials")
