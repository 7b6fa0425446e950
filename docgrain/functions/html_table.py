"""HTML tables to cells. Spans make a cell's place depend on all cells before it, so one table
is read as a whole, in two passes (markup to rows of cells, then their places), inside an Arrow-batched function that receives the HTML column only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate, islice, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ENTITIES

# Markup becomes a list of tokens (mark, name, value): an opening tag with its attributes, a closing
# tag, or text.
OPEN, CLOSE, TEXT = range(3)
Token = tuple[int, str, "dict | str | None"]
CELL_TAGS = ("td", "th")


class _Tokens(HTMLParser):
    """The tokens of any HTML."""

    def __init__(self, html: str) -> None:
        super().__init__()
        self.seen: list[Token] = []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        self.seen.append((OPEN, tag, dict(attrs)))

    def handle_endtag(self, tag):
        self.seen.append((CLOSE, tag, None))

    def handle_data(self, data):
        self.seen.append((TEXT, "", data))


# Markup an OCR engine writes: tags with quoted attributes, and text. Anything else (comments,
# scripts, bare ampersands in attributes, stray brackets) goes through the full parser.
_TOKEN = re.compile(
    r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s+[a-zA-Z][a-zA-Z-]*="[^"&<>]*")*)\s*(/?)>|([^<]+)"""
)
_ATTR = re.compile(r"([a-zA-Z-]+)=\"([^\"]*)\"")
_RAW_TEXT = {
    "script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript",
    "plaintext",
}


def simple_tokens(html: str) -> list[Token] | None:
    """Tokens of simple markup, or None if the full parser has to look at it."""
    tokens: list[Token] = []
    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() != at:
            return None
        at = m.end()
        closing, tag, attrs, empty, text = m.groups()
        if text is not None:
            tokens.append((TEXT, "", unescape(text) if "&" in text else text))
            continue
        tag = tag.lower()
        if tag in _RAW_TEXT:
            return None
        if not closing:
            tokens.append((OPEN, tag, {k.lower(): v for k, v in _ATTR.findall(attrs)}))
        if closing or empty:
            tokens.append((CLOSE, tag, None))
    return tokens if at == len(html) else None


def all_tokens(html: str) -> list[Token]:
    return _Tokens(html).seen


def table_rows_of(tokens: list[Token]) -> dict[int, list[tuple]]:
    """Row number -> its cells (header, rows down, columns across, text), in order.

    Of the tags of cells, an opening one that a closing one follows makes a cell; one that another opening tag
    follows is lost. The cell lies in the row that is open when it ends; -1 is before any row.
    """
    row_at = list(accumulate((mark == OPEN and name == "tr" for mark, name, _ in tokens), initial=-1))
    tags = [(i, mark) for i, (mark, name, _) in enumerate(tokens) if mark != TEXT and name in CELL_TAGS]
    spans = {
        i: tuple(int(tokens[i][2].get(side) or 1) for side in ("rowspan", "colspan"))
        for i, mark in tags
        if mark == OPEN
    }
    rows: dict[int, list[tuple]] = {}
    for (i, mark), (j, following) in pairwise(tags):
        if mark == OPEN and following == CLOSE:
            inside = "".join(
                value if kind == TEXT else "\n"
                for kind, name, value in tokens[i + 1 : j]
                if kind == TEXT or (kind == OPEN and name == "br")
            )
            rows.setdefault(row_at[j], []).append((tokens[i][1] == "th", *spans[i], inside.strip()))
    return rows


def lay_out(rows: dict[int, list[tuple]]) -> list[tuple]:
    """Cells with their places: (row, column, rows down, columns across, text, header).

    ``reach`` lists the stretches of columns that cells of earlier rows still cover, by their
    start, so a row is laid out in one walk along it.
    """
    out: list[tuple] = []
    reach: list[tuple[int, int, int]] = []  # first column, end column, first row below
    for row in sorted(rows):
        reach = [r for r in reach if r[2] > row]
        own: list[tuple[int, int, int]] = []
        col = at = 0
        for header, down, across, text in rows[row]:
            while at < len(reach) and reach[at][0] <= col:
                col = max(col, reach[at][1])
                at += 1
            out.append((row, col, down, across, text, header))
            own.append((col, col + across, row + down))
            col += across
            if across < 0:  # back over cells of this row, which stand in the way from here on
                reach = sorted(reach + [r for r in own if r[2] > row])
                own, at = [r for r in own if r[2] <= row], 0
        reach = sorted(reach + own)
    return out


def _plain(html: str) -> str:
    text = re.sub(r"<[^>]+>", " ", html)
    for entity, char in ENTITIES:
        text = text.replace(entity, char)
    return " ".join(text.split())


def read_cells(html: str | None) -> list[tuple]:
    """Cells of one HTML table; unreadable spans give one cell with the stripped text."""
    if not html:
        return []
    try:
        tokens = simple_tokens(html)
        return lay_out(table_rows_of(all_tokens(html) if tokens is None else tokens))
    except Exception:  # any unreadable table keeps its text
        return [(0, 0, 1, 1, _plain(html), None)]


# Cells that leave a task together; a table of any size leaves in pieces.
CELLS_PER_BATCH = 10_000
_CELL_COLUMNS = [
    ("cell_ord", pa.int32()), ("row_no", pa.int32()), ("col_no", pa.int32()), ("row_span", pa.int32()),
    ("col_span", pa.int32()), ("text", pa.string()), ("is_header", pa.bool_()), ("num_rows", pa.int32()),
    ("num_cols", pa.int32()),
]
CELL_DDL = (
    "cell_ord int, row_no int, col_no int, row_span int, col_span int, text string, is_header boolean, "
    "num_rows int, num_cols int"
)


def placed_cells(html: str | None) -> Iterator[tuple]:
    """The cells of one table with their order and the table's size: rows that only a trailing span
    reaches do not count."""
    cells = read_cells(html)
    rows = max((c[0] + 1 for c in cells), default=0)
    cols = max((c[1] + c[3] for c in cells), default=0)
    for i, cell in enumerate(cells):
        yield (i, *cell, rows, cols)


def cell_rows(df: DataFrame, html: str, keys: list[str]) -> DataFrame:
    """One row per cell. Only the keys and the HTML go to Python, and cells come back as rows, never as one value per table."""
    rows = df.select(*keys, F.col(html).alias("__html"))
    fields = [f for f in rows.schema.fields if f.name != "__html"]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = enumerate(batch.column(len(keys)).to_pylist())
            flat = ((i, *cell) for i, table in tables for cell in placed_cells(table))
            while piece := list(islice(flat, CELLS_PER_BATCH)):
                at, *values = zip(*piece)
                told = batch.select(list(range(len(keys)))).take(pa.array(at, pa.int64()))
                columns = [pa.array(v, t) for v, (_, t) in zip(values, _CELL_COLUMNS)]
                yield pa.RecordBatch.from_arrays(
                    [*told.columns, *columns], names=[*told.schema.names, *[name for name, _ in _CELL_COLUMNS]]
                )

    return rows.mapInArrow(cells, T.StructType([*fields, *T.StructType.fromDDL(CELL_DDL).fields]))


def column_header(header: Column, row: Column) -> Column:
    return F.coalesce(header & (row == 0), F.lit(False))


def row_header(header: Column, row: Column) -> Column:
    return F.coalesce(header & (row > 0), F.lit(False))
