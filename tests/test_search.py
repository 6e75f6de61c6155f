"""Searches over many equal records: results as by looking at every pair, without doing so."""

import time

from tallyloom.operators import advisor


def test_equal_names_are_looked_at_once(spark):
    """4,000 queries and 100,000 records of 20 names; every pair would be 400 million."""
    names = [f"{a} {b}" for a in ("red", "blue", "old", "new", "hot") for b in ("pipe", "bolt", "ring", "ringed")]
    name = f"element_at(array({', '.join(map(repr, names))}), cast(id % 20 as int) + 1)"
    records = spark.range(100_000).selectExpr("id as record_id", f"{name} as item_name", "'' as material_spec")
    queries = spark.range(4_000).selectExpr("id as query_id", f"{name} as text")
    began = time.time()
    got = {}
    for r in advisor.keyword_search(queries, records).collect():
        got.setdefault(r["query_id"], []).append((r["place"], r["record_id"], r["stage"], r["similarity"]))
    assert time.time() - began < 60 and len(got) == 4_000
    for q in range(0, 4_000, 37):
        words = names[q % 20].split()
        want = [i for i in range(200) if all(w in names[i % 20] for w in words)][:5]
        assert sorted(got[q]) == [(k + 1, i, 1, 1.0) for k, i in enumerate(want)]


def test_repeated_rows_of_a_query_and_a_record(spark):
    """Two texts of one query are one question; an id that comes twice counts twice; a missing id asks nothing."""
    records = spark.createDataFrame([(1, "red pipe", None), (1, "red pipe", None), (2, "blue pipe", "rj45"), (3, None, None)], "record_id long, item_name string, material_spec string")
    queries = spark.createDataFrame([(7, "red pipe"), (7, "green pipe"), (8, "green pipe"), (9, "RJ45"), (None, "red"), (10, " "), (11, None)], "query_id long, text string")
    got = sorted((r["query_id"], r["place"], r["record_id"], r["stage"], r["similarity"]) for r in advisor.keyword_search(queries, records).collect())
    assert got == [(7, 1, 1, 1, 1.0), (7, 2, 1, 1, 1.0), (8, 1, 1, 2, 0.5), (8, 2, 1, 2, 0.5), (8, 3, 2, 2, 0.5), (9, 1, 2, 0, 0.0)]


def test_nearest_by_vector_of_all_pairs(spark):
    """Against all pairs, with equal vectors, other lengths, zeros, nulls and no numbers, over several blocks; 40 million pairs in a minute."""
    import math
    import random

    draw = random.Random(9)
    vectors = [(k, [float(draw.randrange(-2, 3)) for _ in range(6)]) for k in range(300)] + [(300 + k, [1.0] * 6) for k in range(30)] + [(400, [1.0, 2.0]), (401, [0.0] * 6), (402, None), (403, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (404, [float("nan")] * 6)]
    frame = lambda rows, i: spark.createDataFrame(rows, f"{i} long, vector array<double>")
    asked = [v for v in vectors if v[0] % 9 == 0 or v[0] >= 400]
    dot = lambda a, b: sum((x * y for x, y in zip(a, b)), 0.0)
    usable = lambda rows: [(i, v, math.sqrt(dot(v, v))) for i, v in rows if v and None not in v and any(v)]
    for digits in (None, 2):
        want = set()
        for q, v, n in usable(asked):
            found = [(i, dot(v, w) / (n * m) if len(v) == len(w) else None) for i, w, m in usable(vectors)]
            place = lambda c: (2, 0) if c is None else (0, 0) if math.isnan(c) else (1, -(math.copysign(math.floor(abs(c) * 100 + 0.5), c) if digits else c))
            want |= {(q, i, p) for p, (i, c) in enumerate(sorted(found, key=lambda x: (*place(x[1]), x[0]))[:7], 1)}
        got = advisor.nearest_by_vector(frame(asked, "query_id"), frame(vectors, "record_id"), 7, block=20, digits=digits).collect()
        have = {(r["query_id"], r["record_id"], r["place"]) for r in got}
        assert have == want and len(got) == len(want), (digits, len(got), len(want), sorted(have - want)[:4], sorted(want - have)[:4])
    wide = lambda n, i: spark.range(n).selectExpr(f"id as {i}", "transform(sequence(1, 64), k -> sin(id * k)) as vector")
    began = time.time()
    assert advisor.nearest_by_vector(wide(1_000, "query_id"), wide(40_000, "record_id")).count() == 4_995 and time.time() - began < 60


def test_sections_by_stretches(spark, monkeypatch):
    """Headings and details stay open over stretches of a sheet, one without a name included."""
    import random

    from pyspark.sql import functions as F

    from tallyloom.operators import items

    draw = random.Random(3)
    kinds = [draw.choice(("group", "detail", "component", "component", "summary")) for _ in range(200)]
    rows = [(draw.choice(("s", None)), k, t, draw.randrange(6) if t == "group" else None, draw.choice((f"N{k}", None)), f"{k}", "") for k, t in enumerate(kinds)]
    df = spark.createDataFrame(rows, "sheet string, row_number long, row_type string, level int, item_name string, normalized_stt string, item_code string")
    found = {}
    for n in (3, 50, 10_000):
        monkeypatch.setattr(items, "STRETCH", n)
        out = items.with_sections(df, "sheet")
        assert out.columns == [*df.columns, "section_path", "section_codes"]
        found[n] = sorted((r["row_number"], r["section_path"], r["section_codes"]) for r in out.collect())
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "stretch__" in plan
    assert found[3] == found[50] == found[10_000] and len(found[3]) == 200 and max(len(p) for _, p, _ in found[3]) > 2
    assert df.select(F.count("*")).first()[0] == 200
