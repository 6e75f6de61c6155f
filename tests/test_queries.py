"""Every query of the catalogue against its SQL on the smallest tables, and the operators on fixtures."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import clusters, compare, match
from tallyloom.plans import bids, catalogue  # noqa: F401

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.7g}"
    return str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    got = catalogue.QUERIES[name](spark, DATA)
    said = con.execute(catalogue.ORACLE[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(map(plain, r)) for r in got.select(*names).collect()) == sorted(tuple(map(plain, r)) for r in said.fetchall())


def test_greedy_assignment(spark):
    draw = random.Random(3)
    pairs = [(a, b, draw.randrange(50)) for a in range(12) for b in range(12) if draw.random() < 0.4]
    used, want = set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            want.add((a, b))
    got = match.assign_one_to_one(spark.createDataFrame(pairs, "a int, b int, s int"), "a", "b", [-F.col("s"), F.col("a"), F.col("b")])
    assert {(r["a"], r["b"]) for r in got.collect()} == want


def test_greedy_assignment_of_tied_rows(spark):
    """Rows of one key on both sides, all of one score, settle one pair a round; none stays unmatched."""
    pairs = spark.range(33).select(F.col("id").alias("a")).crossJoin(spark.range(33).select(F.col("id").alias("b"))).withColumn("s", F.lit(1)).coalesce(1)
    got = match.assign_one_to_one(pairs, "a", "b", [-F.col("s"), F.col("a"), F.col("b")])
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [(k, k) for k in range(33)]


def test_cer_of_whole_texts(spark, tmp_path):
    """Whole texts with accents, null and empty ones, against the table of the edit distance."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            up, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, up[j] + 1, up[j - 1] + (x != y)))
        return row[-1]

    texts = ["déjà vu élève " * 20, "plain letters " * 25, "ABBA", "日本語𝄞テスト", "", None]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    row = catalogue.QUERIES["cer_whole_texts"](spark, str(tmp_path)).collect()
    whole = [t or "" for t in texts]
    edits, chars = sum(distance(t, t[::-1]) for t in whole), sum(max(len(t), 1) for t in whole)
    assert [tuple(r) for r in row] == [(6, 3 / 6, edits, chars, edits / chars)]


def test_thresholds(spark):
    rows = spark.createDataFrame([(100.0, 104.9), (100.0, 105.1), (100.0, 119.9), (100.0, 120.1), (100.0, None), (None, None)], "b double, v double")
    level = compare.numeric_difference(F.col("b"), F.col("v"), 0.05, 0.20)
    assert [r["x"] for r in rows.select(level.alias("x")).collect()] == [None, "WARNING", "WARNING", "CRITICAL", "REVIEW", None]


def one_by_one(nodes, edges):
    """The clusters by taking edge after edge."""
    held = {i: {i} for i, _ in nodes}
    bidder = dict(nodes)
    best = {}
    for a, b, s in edges:
        if None not in (a, b, s) and a != b and a in held and b in held:
            key = (min(a, b), max(a, b))
            best[key] = max(s, best.get(key, s))
    for (a, b), _ in sorted(best.items(), key=lambda e: (-e[1], e[0])):
        x, y = held[a], held[b]
        if x is not y and not {bidder[i] for i in x if bidder[i] is not None} & {bidder[i] for i in y if bidder[i] is not None}:
            x |= y
            for i in y:
                held[i] = x
    return {i: min(x) for i, x in held.items()}


def test_constrained_clusters(spark):
    draw = random.Random(11)
    nodes = [(k, draw.choice((0, 1, 2, 3, None) if k % 9 == 0 else (0, 1, 2, 3))) for k in range(40)]
    edges = [(draw.randrange(40), draw.randrange(40), draw.randrange(6) / 5) for _ in range(120)] + [(1, None, 1.0), (2, 3, None), (5, 5, 2.0), (6, 999, 3.0)]
    n, e = spark.createDataFrame(nodes, "id long, bidder int"), spark.createDataFrame(edges, "a long, b long, score double")
    got = {r["id"]: r["cluster"] for r in clusters.constrained_clusters(n, e).collect()}
    assert got == one_by_one(nodes, edges)
    assert {r["cluster"] for r in clusters.constrained_clusters(n, e.limit(0)).collect()} == set(range(40))
    assert clusters.constrained_clusters(n.limit(0), e).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_peer_clusters(spark):
    rows = catalogue.QUERIES["peer_clusters"](spark, DATA).collect()
    assert len(rows) == len({r["p_partkey"] for r in rows}) == catalogue.read(spark, DATA, "part").count()
    assert len({(r["cluster"], r["bidder"]) for r in rows}) == len(rows)


def test_clusters_within(spark):
    """Groups taken edge after edge, or by rounds, give the same clusters; a chain of ever better scores of 300 links included."""
    draw = random.Random(8)
    nodes = [(g, k + 1000 * n, draw.choice((None, *range(6)))) for n, g in enumerate(("a", None)) for k in range(80)]
    edges = [(g, (x := draw.randrange(80)) + 1000 * n, draw.choice((draw.randrange(80) + 1000 * n, 999, None, x + 1000 * n)), draw.choice((0.5, 1.5, 2.5, None, float("nan")))) for n, g in enumerate(("a", None)) for _ in range(300)]
    long = [("c", 5000 + k, k % 3) for k in range(300)], [("c", 5000 + k, 5001 + k, float(k)) for k in range(299)]
    frame = lambda n, e: (spark.createDataFrame(n, "g string, id long, bidder int"), spark.createDataFrame(e, "g string, a long, b long, score double"))
    n, e = frame(nodes, edges)
    local, rounds = (sorted(map(tuple, clusters.clusters_within(n, e, "g", large=m).collect())) for m in (10_000, 5))
    assert local == rounds and len(local) == 160 and len({c for _, c in local}) < 120
    got = clusters.clusters_within(*frame(*long), "g").collect()
    assert len(got) == 300 and max(Counter(r["cluster"] for r in got).values()) == 3
