"""Operator 10: licences by sparse TF-IDF cosine to templates, inherited from the nearest ancestor directory."""

from __future__ import annotations

from collections import Counter
from math import log, sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import map_batches, materialize, table

#: Fixed values: (licence, usual notice).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("proprietary", "All rights reserved."),
)
LEAST = 0.75
#: A text with at least this share of its words in licence lines is a licence file.
FILE_SHARE = 0.5
#: Directories under a licence file up to which their rows are sent to all tasks.
FEW = 200_000


#: Marks around words, those of comments included.
MARKS = ".,;:!?\"'()[]<>#*/-"


def _terms(text: str) -> list[str]:
    out = (w.strip(MARKS).lower() for w in text.split())
    return [w for w in out if w]


class Templates:
    """Unit TF-IDF vectors of the templates; a term of none of them has the largest weight."""

    def __init__(self, templates=TEMPLATES):
        rows = [(name, Counter(_terms(text))) for name, text in templates]
        df = Counter(w for _, c in rows for w in c)
        self.unseen = log(1 + len(rows)) + 1
        self.idf = {w: log((1 + len(rows)) / (1 + n)) + 1 for w, n in df.items()}
        self.vectors = []
        self.holding: dict[str, list[tuple[int, float]]] = {}
        for k, (name, c) in enumerate(rows):
            norm = sqrt(sum((n * self.idf[w]) ** 2 for w, n in c.items()))
            self.vectors.append(name)
            for w, n in c.items():
                self.holding.setdefault(w, []).append((k, n * self.idf[w] / norm))

    def best(self, terms: list[str], least: float = 0.0) -> tuple[float, str | None]:
        """The highest cosine and its licence, the first template at a tie; 0 where it is sure to be below ``least``.

        A cosine is at most the part of the vector's length that lies in known
        terms. Each other term adds its weight's square at least once, so that
        bound is known before the others are counted.
        """
        counts = Counter(w for w in terms if w in self.idf)
        if not counts:
            return 0.0, None
        others = [w for w in terms if w not in self.idf]
        known = sum((n * self.idf[w]) ** 2 for w, n in counts.items())
        if known < least * least * (known + len(others) * self.unseen**2):
            return 0.0, None
        norm = sqrt(known + sum((n * self.unseen) ** 2 for n in Counter(others).values()))
        dots = [0.0] * len(self.vectors)
        for w, n in counts.items():
            for k, x in self.holding[w]:
                dots[k] += n * self.idf[w] * x
        top = max(range(len(dots)), key=lambda k: (dots[k], -k))
        return dots[top] / norm, self.vectors[top]


class _Words(dict):
    """Terms of raw words, made once a word."""

    def __missing__(self, raw):
        if len(self) > 1_000_000:
            self.clear()
        self[raw] = out = raw.strip(MARKS).lower()
        return out


def judge(text: str | None, known: Templates, least: float, words: dict) -> tuple[str | None, float | None, float]:
    """(licence, cosine, share) of a whole text.

    Every line and every paragraph (run of lines that are not blank, as a
    notice may be broken over lines) is compared with every template, and the
    best, the first at a tie, counts if it reaches ``least``. share is the
    part of the text's words in lines or paragraphs that reach it.
    """
    best, name, inside, total = 0.0, None, 0, 0
    for paragraph in _paragraphs(text or ""):
        lines = [[t for t in map(words.__getitem__, line.split()) if t] for line in paragraph]
        size, hit = sum(map(len, lines)), 0
        total += size
        if not any(w in known.idf for terms in lines for w in terms):
            continue
        for terms in lines:
            score, licence = known.best(terms, least)
            if score >= least:
                hit += len(terms)
                if score > best:
                    best, name = score, licence
        if len(lines) > 1:
            score, licence = known.best([w for terms in lines for w in terms], least)
            if score >= least:
                hit = size
                if score > best:
                    best, name = score, licence
        inside += hit
    return name, best if name else None, inside / total if total else 0.0


def _paragraphs(text: str):
    held: list[str] = []
    for line in text.split("\n"):
        if line.strip():
            held.append(line)
        elif held:
            yield held
            held = []
    if held:
        yield held


def own_licences(files: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(id, path, licence, score, share) of every row of ``files(id, path, text)``, see :func:`judge`."""

    def run(batches):
        import pyarrow as pa

        known, words = Templates(templates), _Words()
        for batch in batches:
            found = [judge(text.as_py(), known, least, words) for text in batch.column(2)]
            cols = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["id", "path", "licence", "score", "share"])

    kind = files.schema["id"].dataType.simpleString()
    return map_batches(files.select("id", "path", "text"), run, f"id {kind}, path string, licence string, score double, share double")


def inherit(found: DataFrame, share: float = FILE_SHARE) -> DataFrame:
    """Adds effective and from_dir: a file's own licence, else that of the nearest ancestor directory with a licence file.

    Of several licence files in a directory the one of the highest score, then
    the smallest path, counts. Directories are joined by path. Those under a
    licence file are sent to all tasks where they are ``FEW`` or less, so that
    a directory with a third of all files is no task's alone; more are joined,
    where Spark splits such a directory. ``found`` is read three times, so it
    should be a written table.
    """
    folder = lambda path: F.regexp_replace(F.coalesce(path, F.lit("")), r"/?[^/]*$", "")
    files = found.withColumn("dir__", folder(F.col("path")))
    sources = files.where(F.col("licence").isNotNull() & (F.col("share") >= share)).groupBy(F.col("dir__").alias("at")).agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "licence")).alias("x")).select("at", F.col("x.licence").alias("given"))
    parts = F.split("dir__", "/")
    above = files.select("dir__").distinct().select("dir__", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("at"))
    nearest = above.distinct().join(sources, "at").groupBy("dir__").agg(F.max(F.struct(F.length("at").alias("n"), "at", "given")).alias("x")).select("dir__", F.col("x.at").alias("from__"), F.col("x.given").alias("given"))
    nearest = materialize(nearest, "nearest")
    out = files.join(F.broadcast(nearest) if nearest.count() <= FEW else nearest, "dir__", "left")
    own = F.col("licence").isNotNull()
    return out.select(*found.columns, F.when(own, F.col("licence")).otherwise(F.col("given")).alias("effective"), F.when(~own, F.col("from__")).alias("from_dir"))


def scan_licences(files: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(id, path, licence, score, share, effective, from_dir) of every row of ``files(id, path, text)``.

    Null and empty texts have no licence of their own and may inherit one; a
    null path lies in the root directory. Repeated rows are judged alike;
    other columns are ignored.
    """
    return inherit(materialize(own_licences(files, templates, least), "licences"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id.txt``."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt"))
    return scan_licences(docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text")).withColumnRenamed("id", "doc_id")


QUERIES = {"op10_licences": op10_licences}
ORACLE: dict[str, str] = {}
