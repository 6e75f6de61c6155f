"""Texts of documents and members of archives, from any store Spark can read."""

from __future__ import annotations

import io
import re
import zipfile
from html import unescape
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workbook import cells

READABLE = ("txt", "md", "docx", "xlsx")


def _docx(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        parts = sorted((n for n in book.namelist() if re.fullmatch(r"word/(document|header\d*|footer\d*)\.xml", n)), key=lambda n: (n != "word/document.xml", n))
        xml = "\n".join(book.read(n).decode("utf-8", "ignore") for n in parts)
    for pattern, stands in ((r"</w:p>|<w:br\b[^>]*/?>", "\n"), (r"</w:tc>", "\t"), (r"<[^>]+>", "")):
        xml = re.sub(pattern, stands, xml)
    return unescape(xml)


def _xlsx(content: bytes) -> str:
    lines: dict[tuple[str, int], list[str]] = {}
    for sheet, row, _, _, text, *_ in cells(content, None, 1_048_576):
        if text and text.strip():
            lines.setdefault((sheet, row), []).append(text.strip())
    out, last = [], None
    for (sheet, _), texts in lines.items():
        if sheet != last:
            out.append(f"--- {sheet} ---")
            last = sheet
        out.append(" | ".join(texts))
    return "\n".join(out)


def text_of(name: str, content: bytes) -> tuple[str | None, str | None]:
    """(text, reason): the text of a file by its ending, or why there is none."""
    ending = name.rpartition(".")[2].lower()
    try:
        if ending in ("txt", "md"):
            return content.decode("utf-8", "ignore"), None
        if ending == "docx":
            return _docx(content), None
        if ending == "xlsx":
            return _xlsx(content), None
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, RuntimeError, IndexError) as e:
        return None, type(e).__name__
    return None, f"cannot read .{ending}"


def document_texts(spark: SparkSession, path: str, most_members: int = 400) -> DataFrame:
    """(path, member, text, skipped) of every file below ``path``; archives give a row a member, the first ``most_members`` are read and the others named.

    A file is one task's work. Texts are whole; skipped says why there is none.
    """

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for file, content in zip(frame["path"], frame["content"]):
                if not file.lower().endswith(".zip"):
                    rows.append((file, None, *text_of(file, content)))
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as book:
                        members = [m for m in book.namelist() if not m.endswith("/")]
                        for k, m in enumerate(members):
                            read = k < most_members and m.rpartition(".")[2].lower() in READABLE
                            rows.append((file, m, *(text_of(m, book.read(m)) if read else (None, "too many members" if k >= most_members else text_of(m, b"")[1]))))
                except (zipfile.BadZipFile, RuntimeError) as e:
                    rows.append((file, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "member", "text", "skipped"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, member string, text string, skipped string")


def tree_hash(spark: SparkSession, path: str) -> DataFrame:
    """(files, sha256): one hash of the names and contents of all files below ``path``; the list of hashes is sorted in one task, one line a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    each = files.select(F.concat_ws(":", "path", F.sha2("content", 256)).alias("line"))
    return each.agg(F.count(F.lit(1)).alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("sha256"))


def json_lines(spark: SparkSession, path: str, schema: str = "id string, text string") -> DataFrame:
    return spark.read.schema(schema).json(path)
