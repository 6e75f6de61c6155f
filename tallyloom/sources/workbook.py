"""Cells of spreadsheet files (OOXML), read from any store Spark can read; a file is one task's work, and no file is held twice."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "workbook string, sheet string, row_number long, column_number int, kind string, text string, number double, formula string"
#: Rows read beyond ``max_rows``, so that a title and a header do not cost data.
SPARE_ROWS = 100
_LINKED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_number(reference: str) -> int:
    """The number of a cell's column, A as 1; 0 without letters."""
    out = 0
    for letter in re.match(r"[A-Za-z]*", reference)[0].upper():
        out = out * 26 + ord(letter) - 64
    return out


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _inner_text(node) -> str:
    """All text runs below a node, without the phonetic ones."""
    out = []
    for child in node:
        kind = _name(child.tag)
        if kind == "t":
            out.append(child.text or "")
        elif kind == "r":
            out.append(_inner_text(child))
    return "".join(out)


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as part:
        for _, node in ElementTree.iterparse(part):
            if _name(node.tag) == "si":
                out.append(_inner_text(node))
                node.clear()
    return out


def sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet, part) in the order of the workbook; targets may be absolute or relative to xl/."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    found = [(s.get("name"), links.get(s.get(_LINKED), "")) for s in root.iter() if _name(s.tag) == "sheet"]
    return [(name, t[1:] if t.startswith("/") else f"xl/{t}") for name, t in found if t]


def _value(cell, strings: list[str]) -> tuple[str, str | None, float | None, str | None]:
    """(kind, text, number, formula) of a cell element."""
    parts = {_name(child.tag): child for child in cell}
    raw = parts["v"].text if "v" in parts else None
    formula = (parts["f"].text or "") if "f" in parts else None
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "text", _inner_text(parts["is"]) if "is" in parts else "", None, formula
    if raw is None:
        return "blank", None, None, formula
    if kind == "s":
        return "text", strings[int(raw)], None, formula
    if kind == "b":
        return "bool", "TRUE" if raw == "1" else "FALSE", None, formula
    if kind == "n":
        return "number", raw, float(raw), formula
    return ("error" if kind == "e" else "text"), raw, None, formula


def cells(content: bytes, sheets: frozenset[str] | None, max_rows: int) -> Iterator[tuple]:
    """(sheet, row, column, kind, text, number, formula) of every cell with a value or a formula."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings = _shared_strings(book)
        for sheet, part in sheet_parts(book):
            if (sheets is not None and sheet not in sheets) or part not in book.namelist():
                continue
            row = column = 0
            with book.open(part) as stream:
                for event, node in ElementTree.iterparse(stream, ("start", "end")):
                    kind = _name(node.tag)
                    if kind == "row" and event == "start":
                        row, column = int(node.get("r", row + 1)), 0
                        if row > max_rows + SPARE_ROWS:
                            break
                    elif kind == "c" and event == "end":
                        column = column_number(node.get("r", "")) or column + 1
                        got = _value(node, strings)
                        if got[0] != "blank" or got[3] is not None:
                            yield (sheet, row, column, *got)
                    elif kind == "row":
                        node.clear()


def read_workbooks(spark: SparkSession, path: str, sheets: list[str] | None = None, max_rows: int = 1_000_000) -> DataFrame:
    """A row for every filled cell of every workbook under ``path``.

    ``sheets`` reads only those of these names. A file that cannot be read
    gives one row of kind ``unreadable`` with the reason as its text (after
    the cells read before the fault), so that one bad file stops no job.
    Files of no bytes give nothing: Spark's file scan leaves them out.
    """
    wanted = None if sheets is None else frozenset(sheets)

    def run(frames):
        import pandas as pd

        names = ["workbook", *"sheet row_number column_number kind text number formula".split()]
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"]):
                held: list[tuple] = []
                try:
                    for cell in cells(content, wanted, max_rows):
                        held.append((file, *cell))
                        if len(held) == 50_000:
                            yield pd.DataFrame(held, columns=names)
                            held = []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, RuntimeError) as e:
                    held.append((file, None, None, None, "unreadable", f"{type(e).__name__}: {e}", None, None))
                if held:
                    yield pd.DataFrame(held, columns=names).astype({"row_number": "Int64", "column_number": "Int32", "number": "float64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def sheet_catalogue(cell_rows: DataFrame) -> DataFrame:
    """(workbook, sheet, n_rows, n_columns) as far as cells are filled."""
    readable = cell_rows.where("sheet is not null and kind <> 'blank'")
    return readable.groupBy("workbook", "sheet").agg(F.max("row_number").alias("n_rows"), F.max("column_number").alias("n_columns"))


def cell_issues(cell_rows: DataFrame) -> DataFrame:
    """Cells that hold an error, or whose formula reaches into another workbook: the cells with kind of issue and severity."""
    linked = F.col("formula").rlike(r"\[[^\]]+\][^!]*!")
    issue = F.when(F.col("kind") == "error", "formula_error").when(linked, "external_link")
    return cell_rows.withColumn("issue", issue).where("issue is not null").withColumn("severity", F.when(F.col("issue") == "formula_error", "CRITICAL").otherwise("REVIEW"))


def file_kind(content: Column) -> Column:
    """What a file's first bytes say it is: empty, zip, ole2 (old or encrypted), pdf, image or unknown."""
    head = F.hex(F.substring(content, 1, 8))
    starts = lambda *signs: head.rlike("^(" + "|".join(signs) + ")")
    out = F.when(content.isNull() | (F.length(content) == 0), "empty").when(starts("504B0304", "504B0506"), "zip")
    return out.when(starts("D0CF11E0A1B11AE1"), "ole2").when(starts("25504446"), "pdf").when(starts("89504E47", "FFD8FF", "47494638", "424D"), "image").otherwise("unknown")


def file_signatures(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, kind, sha256) of every file under ``path`` that has any bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), file_kind(F.col("content")).alias("kind"), F.sha2("content", 256).alias("sha256"))
