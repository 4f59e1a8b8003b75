"""Structured rows from HTML pages: cells of nested tables with their places in the grid, links and images."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, MapType, StringType, StructField, StructType

#: The largest spans that HTML knows.
MOST_ACROSS, MOST_DOWN = 1000, 65_534
MOST_ROWS = 20_000
#: Elements whose text is no text of the page.
SILENT = {"script", "style", "noscript", "template"}
#: A tag as most pages write it, and its attributes.  A page of such tags of common elements alone, without references, comments or stray brackets, needs no parser to be cut.
_ATTRIBUTES = r"""(?:[ \n\t]+[a-z][a-z-]*=(?:"[^"<>]*"|'[^'<>]*'|[0-9a-zA-Z%#-]+))*"""
_PLAIN_TAG = re.compile(rf"<(/?)([a-z][a-z0-9]*)({_ATTRIBUTES})>")
_WHOLE_TAG = re.compile(rf"(</?[a-z][a-z0-9]*{_ATTRIBUTES}>)")
_ATTRIBUTE = re.compile(r"""([a-z-]+)=(?:"([^"]*)"|'([^']*)'|([^ \n\t]+))""")
_COMMON = frozenset("table tbody thead tfoot caption tr td th p div span a img br hr b i u em strong sub sup small ul ol li dl dt dd h1 h2 h3 h4 h5 h6 html head body section article header footer script style".split())
_TOLD = frozenset(("table", "tr", "a", "img", "script", "style"))
_READ_WITH = frozenset(("td", "th", "a", "img"))
#: How many sequences of tags a worker keeps, none longer than so many characters.
MOST_SHAPES, MOST_SHAPE_CHARS = 512, 8_192


@dataclass
class _Table:
    """An open table: where it stands, its place in the page, and down to which row each column of its grid is taken."""

    number: int
    parent: tuple[int | None, int | None, int | None]
    row: int = -1
    cell: int = -1
    taken: dict[int, int] = field(default_factory=dict)
    open: tuple | None = None
    text: list[str] = field(default_factory=list)

    def place(self, across: int, down: int) -> int:
        """The first free column of the row, taken from now on for the cell's spans."""
        column = 0
        while self.taken.get(column, -1) >= self.row:
            column += 1
        if across == 1:
            self.taken[column] = self.row + down - 1
            return column
        for c in range(column, column + across):
            self.taken[c] = max(self.taken.get(c, -1), self.row + down - 1)
        return column


def _span(value: str | None, most: int) -> int:
    value = (value or "").strip()
    return min(most, max(1, int(value))) if value.isascii() and value.isdecimal() else 1


class _Cells(HTMLParser):
    """Cells of every table, outer ones with the text of what is nested in them, and links and images."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.links: list[tuple[str, str]] = []
        self.tables: list[_Table] = []
        self.seen = self.silent = 0

    def _close_cell(self) -> None:
        table = self.tables[-1]
        if table.open is not None:
            self.rows.append((table.number, *table.parent, *table.open, " ".join("".join(table.text).split())))
            table.open, table.text = None, []

    def _close_table(self) -> None:
        self._close_cell()
        self.tables.pop()

    def read(self, text: str) -> None:
        """The whole page: cut at its tags if all are plain, else by the parser, with the same calls."""
        if not self._read_plain(text):
            self.feed(text)
            self.close()

    def _read_plain(self, text: str) -> bool:
        if "&" in text:
            return False
        parts = _PLAIN_TAG.split(text)
        return 4 * text.count("<") == len(parts) - 1 and self._walk(parts)

    def _walk(self, parts: list) -> bool:
        """Through a page's tags and what stands between them; false if not all tags are plain."""
        closing, names = parts[1::4], parts[2::4]
        if not _COMMON.issuperset(names) or any(map("".__ne__, (a for c, a in zip(closing, parts[3::4], strict=True) if c))):
            return False
        for at, name in enumerate(names):  # what opens a script or style is closed by the next tag
            if name in SILENT and not closing[at] and (at + 1 == len(names) or names[at + 1] != name or not closing[at + 1]):
                return False
        start, end, data = self.handle_starttag, self.handle_endtag, self.handle_data
        tables = self.tables
        for c, name, known, behind in zip(closing, names, parts[3::4], parts[4::4], strict=True):
            cell = name == "td" or name == "th"
            if cell and tables and (c or not known):
                if not c:
                    self._open_plain(name == "th")
                elif tables[-1].open is not None:
                    self._close_cell()
            elif cell or name in _TOLD:
                if c:
                    end(name)
                else:
                    start(name, [(k, x or y or z) for k, x, y, z in _ATTRIBUTE.findall(known)] if known and name in _READ_WITH else ())
            if behind and tables:
                data(behind)
        return True

    def finish(self) -> list[tuple]:
        """All cells by table, row and cell."""
        while self.tables:
            self._close_table()
        return sorted(self.rows, key=itemgetter(0, 4, 5))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        known = dict(attrs) if attrs else {}
        if tag in SILENT:
            self.silent += 1
        elif tag == "table":
            outer = self.tables[-1] if self.tables else None
            inside = outer is not None and outer.open is not None
            self.tables.append(_Table(self.seen, (outer.number, outer.open[0], outer.open[1]) if inside else (outer.number if outer else None, None, None)))
            self.seen += 1
        elif tag in ("a", "img"):
            target = known.get("href" if tag == "a" else "src")
            if target:
                self.links.append((tag, target))
        elif self.tables and tag == "tr":
            self._close_cell()
            self.tables[-1].row, self.tables[-1].cell = self.tables[-1].row + 1, -1
        elif self.tables and tag in ("td", "th"):
            self._close_cell()
            table = self.tables[-1]
            table.row, table.cell = max(0, table.row), table.cell + 1
            across, down = _span(known.get("colspan"), MOST_ACROSS), _span(known.get("rowspan"), MOST_DOWN)
            table.open = (table.row, table.cell, table.place(across, down), tag == "th", across, down)

    def _open_plain(self, header: bool) -> None:
        """A cell without spans in an open table."""
        table = self.tables[-1]
        if table.open is not None:
            self._close_cell()
        table.row, table.cell = max(0, table.row), table.cell + 1
        table.open = (table.row, table.cell, table.place(1, 1), header, 1, 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif self.tables and tag in ("td", "th", "tr"):
            self._close_cell()
        elif self.tables and tag == "table":
            self._close_table()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            for table in self.tables:
                if table.open is not None:
                    table.text.append(data)


class _Shape(_Cells):
    """The cells of all pages with one sequence of plain tags: a cell's text is the numbers of the stretches between tags that it holds."""

    def __init__(self, tags: str) -> None:
        super().__init__()
        parts = _PLAIN_TAG.split(tags)
        parts[4::4] = [(i,) for i in range(1, len(parts) // 4 + 1)]
        self.plain = self._walk(parts)
        #: (table_no, row_no, [(col_no, numbers of the cells over each other)]) of each row of the grids, and each cell's stretches.
        self.grid: list[tuple[int, int, list[tuple[int, list[int]]]]] = []
        self.held: list[list[int]] = []
        if self.plain:
            cells = self.finish()
            self.held = [cell[-1] for cell in cells]
            self.grid = _grid_rows(cells)

    def _close_cell(self) -> None:
        table = self.tables[-1]
        if table.open is not None:
            self.rows.append((table.number, *table.parent, *table.open, [i for (i,) in table.text]))
            table.open, table.text = None, []


def _grid_rows(cells: list[tuple]) -> list[tuple[int, int, list[tuple[int, list[int]]]]]:
    """(table_no, row_no, [(col_no, numbers of the cells that cover it)]) of a page's cells by table, row and cell."""
    last: dict[int, int] = {}
    for cell in cells:
        last[cell[0]] = cell[4]
    rows: dict[tuple[int, int], dict[int, list[int]]] = {}
    for i, (table, _, _, _, row, _, column, _, across, down, _) in enumerate(cells):
        for r in range(row, min(row + down - 1, last[table]) + 1):
            slots = rows.setdefault((table, r), {})
            for c in range(column, column + across):
                slots.setdefault(c, []).append(i)
    return [(*at, list(slots.items())) for at, slots in rows.items()]


def _page_rows(text: str, shapes: dict[str, _Shape]) -> tuple[list[tuple[int, int, list[tuple[int, list[int]]]]], list[str]]:
    """The rows of a page's grids and its cells' texts; pages with the same plain tags share one walk."""
    if "&" not in text:
        parts = _WHOLE_TAG.split(text)
        tags = "".join(parts[1::2])
        if 2 * text.count("<") == len(parts) - 1:
            shape = shapes.get(tags)
            if shape is None:
                shape = _Shape(tags)
                if len(tags) <= MOST_SHAPE_CHARS:
                    if len(shapes) >= MOST_SHAPES:
                        shapes.clear()
                    shapes[tags] = shape
            if shape.plain:
                between = parts[0::2]
                return shape.grid, [" ".join((between[held[0]] if len(held) == 1 else "".join([between[i] for i in held])).split()) for held in shape.held]
    parser = _Cells()
    parser.read(text)
    cells = parser.finish()
    return _grid_rows(cells), [cell[-1] for cell in cells]


_CELL_COLUMNS = ["table_no", "parent_table", "parent_row", "parent_cell", "row_no", "cell_no", "col_no", "header", "colspan", "rowspan", "text"]
_CELL_KINDS = "table_no int, parent_table int, parent_row int, parent_cell int, row_no int, cell_no int, col_no int, header boolean, colspan int, rowspan int, text string"


def table_cells(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row for each cell of each table: key, table_no, parent_table, parent_row, parent_cell, row_no, cell_no, col_no, header, colspan, rowspan, text.

    Tables are numbered as they open; a nested one names the cell that it stands
    in.  A cell's col_no is its first column in the grid, past columns that cells
    of rows above reach down into.  Text is that of all that a cell holds, nested
    tables too, scripts and styles left out, blanks collapsed.  Spans that are no
    number count as 1; open cells and tables end with the page; null pages have none.
    """
    kinds = [pa.bool_() if c == "header" else pa.string() if c == "text" else pa.int32() for c in _CELL_COLUMNS]
    return _by_page(pages, key, html, lambda parser: parser.finish(), _CELL_COLUMNS, kinds, _CELL_KINDS)


def _slots(cells: list[tuple]) -> list[tuple]:
    """(table_no, row_no, col_no, text, header) of each slot that a page's cells cover, from its cells by table, row and cell."""
    last: dict[int, int] = {}
    for cell in cells:
        last[cell[0]] = cell[4]
    slots: dict[tuple[int, int, int], tuple[str | None, bool]] = {}
    for table, _, _, _, row, _, column, header, across, down, text in cells:
        value = (text.strip(" ") or None, header)
        for r in range(row, min(row + down - 1, last[table]) + 1):
            for c in range(column, column + across):
                at = (table, r, c)
                held = slots.get(at)
                slots[at] = value if held is None else (held[0] or value[0], held[1] or header)
    return [(*at, *x) for at, x in slots.items()]


def page_grids(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """table_grid of the table_cells of pages whose keys differ, in one pass without a shuffle: a page's cells lie together already."""
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
    return _by_page(pages, key, html, lambda parser: _slots(parser.finish()), ["table_no", "row_no", "col_no", "text", "header"], kinds, "table_no int, row_no int, col_no int, text string, header boolean")


def page_rows(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, table_no, row_no, cells (col_no to text): page_grids with one row for each row of a grid."""
    kind = pages.schema[key].dataType
    texts_kind = pa.map_(pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes: dict[str, _Shape] = {}

        def batch_of(keys: pa.Array, at: list[int], tables: list[int], rows: list[int], ends: list[int], columns: list[int], texts: list[str | None]) -> pa.RecordBatch:
            cells = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(columns, pa.int32()), pa.array(texts, pa.string())).cast(texts_kind)
            values = [keys.take(pa.array(at, pa.int64())), pa.array(tables, pa.int32()), pa.array(rows, pa.int32()), cells]
            return pa.RecordBatch.from_arrays(values, [key, "table_no", "row_no", "cells"])

        for batch in batches:
            keys = batch.column(0)
            made: tuple = ([], [], [], [0], [], [])
            for i, text in enumerate(batch.column(1)):
                at, tables, rows, ends, columns, texts = made
                grid, known = _page_rows(text.as_py() or "", shapes)
                for table, row, slots in grid:
                    at.append(i)
                    tables.append(table)
                    rows.append(row)
                    for c, over in slots:
                        columns.append(c)
                        texts.append((known[over[0]] if len(over) == 1 else next((known[x] for x in over if known[x]), None)) or None)
                    ends.append(len(texts))
                if len(texts) >= MOST_ROWS:
                    yield batch_of(keys, *made)
                    made = ([], [], [], [0], [], [])
            if made[0]:
                yield batch_of(keys, *made)

    return pages.select(key, html).mapInArrow(run, StructType([StructField(key, kind), StructField("table_no", IntegerType()), StructField("row_no", IntegerType()), StructField("cells", MapType(IntegerType(), StringType()))]))


def _by_page(pages: DataFrame, key: str, html: str, made, columns: list[str], kinds: list[pa.DataType], schema: str) -> DataFrame:
    """key and the columns of the rows that ``made`` gives of each page's parser, some MOST_ROWS at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(keys: pa.Array, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
            values = [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([keys.take(pa.array(np.array(at, np.int64))), *values], [key, *columns])

        for batch in batches:
            keys, at, rows = batch.column(0), [], []
            for i, text in enumerate(batch.column(1)):
                parser = _Cells()
                parser.read(text.as_py() or "")
                found = made(parser)
                rows += found
                at += [i] * len(found)
                if len(rows) >= MOST_ROWS:
                    yield batch_of(keys, at, rows)
                    at, rows = [], []
            if rows:
                yield batch_of(keys, at, rows)

    return pages.select(key, html).mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, {schema}")


def page_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, position, tag, target of every link and image."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text in zip(batch[key], batch[html], strict=True):
                parser = _Cells()
                parser.read(text or "")
                out += [(k, i, tag, target) for i, (tag, target) in enumerate(parser.links)]
            yield pd.DataFrame(out, columns=[key, "position", "tag", "target"])

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, position int, tag string, target string")
