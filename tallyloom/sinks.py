"""What comparisons are written to: named tables of a report, stores that are appended to, a manifest."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a spreadsheet below its header.
SHEET_ROWS = 1_048_574


def write_report(tables: dict[str, DataFrame], path: str, kind: str = "parquet", sheet_rows: int = SHEET_ROWS) -> list[str]:
    """Every table under its name below ``path``, in files of no more rows than a sheet holds; the paths written."""
    written = []
    for name, df in tables.items():
        df.write.mode("overwrite").option("maxRecordsPerFile", sheet_rows).option("header", True).format(kind).save(f"{path}/{name}")
        written.append(f"{path}/{name}")
    return written


def append(df: DataFrame, path: str) -> None:
    """Records, logs, feedback and audit events are appended, never changed; readers take the latest."""
    df.write.mode("append").parquet(path)


def clear(df: DataFrame, path: str) -> None:
    """Leaves the store at ``path`` with the columns of ``df`` and no row."""
    df.limit(0).write.mode("overwrite").parquet(path)


def write_manifest(df: DataFrame, path: str, **facts) -> None:
    """One JSON line of facts beside the tables of a report."""
    df.sparkSession.createDataFrame([(json.dumps(facts, ensure_ascii=False, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def safe_file_name(name: Column, fallback: str = "file") -> Column:
    """Letters, digits, dots, dashes and underscores of a name, 120 at most."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\w.\-]+", "_"), r"^[ ._]+|[ ._]+$", "")
    return F.when(out == "", fallback).otherwise(F.substring(out, 1, 120))


def sheet_names(names: DataFrame, name: str) -> DataFrame:
    """Adds sheet_name: 31 characters without []:*?/\\ that no earlier name has in any case; later ones get a number."""
    plain = F.substring(F.trim(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"[\[\]:*?/\\]", " ")), 1, 31)
    base = names.withColumn("base__", F.when(plain == "", "Hạng mục").otherwise(plain))
    place = F.row_number().over(Window.partitionBy(F.lower("base__")).orderBy(name))
    tail = F.format_string(" (%d)", F.col("place__"))
    out = base.withColumn("place__", place)
    return out.withColumn("sheet_name", F.when(F.col("place__") == 1, F.col("base__")).otherwise(F.concat(F.expr("left(base__, 31 - length(format_string(' (%d)', place__)))"), tail))).drop("base__", "place__")
