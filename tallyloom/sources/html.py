"""Tables of HTML pages as rows of cells."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks in the flat form of a page: a row begins, a cell, row and table ends.
_BEGIN, _CELL, _ROW, _TABLE = "\x1c", "\x1f", "\x1e", "\x1d"
_NO_MARKS = dict.fromkeys(map(ord, _BEGIN + _CELL + _ROW + _TABLE), " ")


class _Flat(HTMLParser):
    """Writes the cells of outer tables one after the other, with a mark where something ends; text of inner tables falls to the cell around them."""

    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.text: list[str] | None = None
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "table"
        if tag == "br" and self.text is not None:
            self.text.append(" ")
        if self.depth == 1 and tag == "tr":
            self.out.append(_BEGIN)
        if self.depth == 1 and tag in ("td", "th"):
            self.text = []

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data.translate(_NO_MARKS))

    def handle_endtag(self, tag):
        if self.depth == 1 and tag in ("td", "th") and self.text is not None:
            self.out += (" ".join("".join(self.text).split()), _CELL)
            self.text = None
        if self.depth == 1 and tag in ("tr", "table"):
            self.out.append(_ROW if tag == "tr" else _TABLE)
        self.depth -= tag == "table" and self.depth > 0


def table_cells(page: str | None) -> list[tuple[int, int, int, str]]:
    """(table, row, column, text), from 1, of every closed cell of the outer tables; rows without text and tables without rows do not count."""
    flat = _Flat()
    flat.feed(page or "")
    found, tables = [], 0
    for table in "".join(flat.out).split(_TABLE)[:-1]:
        rows = [r.rsplit(_BEGIN, 1)[1].split(_CELL)[:-1] for r in table.split(_ROW)[:-1] if _BEGIN in r]
        rows = [r for r in rows if any(r)]
        tables += bool(rows)
        found += [(tables, i, j, text) for i, r in enumerate(rows, 1) for j, text in enumerate(r, 1)]
    return found


def html_table_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table_no, row_no, column_no, cell) of all cells of ``html``; null and empty pages have none.

    No shuffle: pages are read in Arrow batches where they lie, one page at a time.
    """
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k, page in zip(batch.column(0), batch.column(1).to_pylist()):
                cells = table_cells(page)
                if cells:
                    numbers = [pa.array([c[i] for c in cells], pa.int32()) for i in range(3)]
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(cells), batch.column(0).type), *numbers, pa.array([c[3] for c in cells], pa.string())], [key, "table_no", "row_no", "column_no", "cell"])

    return pages.select(F.col(key), F.col(html)).mapInArrow(run, f"`{key}` {kind}, table_no int, row_no int, column_no int, cell string")
