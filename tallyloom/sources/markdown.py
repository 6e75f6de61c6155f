"""Cells of Markdown pipe tables as rows, by array functions within each text: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULE = r"^\s*\|?(\s*:?-+:?\s*\|)*\s*:?-+:?\s*\|?\s*$"


def _cells(line: Column) -> Column:
    """Trimmed cells of a line, without its outer pipes; an escaped pipe stays in its cell."""
    inner = F.regexp_replace(F.trim(line), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))


def markdown_table_cells(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, table_number, row_number, column_number, text) of the tables in every text, numbered from 1.

    A table is a run of neighbouring lines that start with a pipe, of two rows
    at least once lines of dashes are left out. Null and empty texts, and texts
    without tables, give no rows; repeated rows give their cells again.
    """
    lines = F.split(F.regexp_replace(F.coalesce(text_column, F.lit("")), r"\r\n?", "\n"), "\n")
    # Runs: lines that are no table become a form feed, and form feeds part the tables.
    marked = F.array_join(F.transform(lines, lambda x: F.when(x.rlike(r"^\s*\|"), F.replace(x, F.lit("\f"), F.lit(" "))).otherwise("\f")), "\n")
    runs = F.filter(F.split(marked, "\f"), lambda run: run.contains("|"))
    rows = F.transform(runs, lambda run: F.filter(F.split(run, "\n"), lambda x: x.contains("|") & ~x.rlike(RULE)))
    tables = F.filter(rows, lambda t: F.size(t) >= 2)
    out = docs.select(F.col(id_column), F.posexplode(tables).alias("t", "lines"))
    out = out.select(id_column, (F.col("t") + 1).alias("table_number"), F.posexplode("lines").alias("r", "line"))
    out = out.select(id_column, "table_number", (F.col("r") + 1).alias("row_number"), F.posexplode(_cells(F.col("line"))).alias("c", "text"))
    return out.select(id_column, "table_number", "row_number", (F.col("c") + 1).alias("column_number"), "text")
