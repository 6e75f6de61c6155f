"""Every stage of the pipeline on rows with nulls, repeats and clashing columns, and the near copies by comparing all pairs."""

import random

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
from tallyloom.llm import simhash  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, sources string, dropped int"


def words(draw, n):
    return ["".join(draw.choices("abcdefghij", k=draw.randint(3, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    draw, out = random.Random(6), []
    for k in range(12):
        own = words(draw, 120)
        out.append((k, " ".join(own), "en", "a" if k % 2 else None, 1, 0.5, "x", "s", 3))
        if k % 3 == 0:
            own[60] = "changed"
            out.append((100 + k, " ".join(own), None, "b", 1, 0.5, "x", "s", 3))
    alone = (None, " ".join(words(draw, 80)), "en", "a", 1, None, None, None, None)
    return [*out, alone, alone, (None, " ".join(words(draw, 80)), "en", "a", 1, None, None, None, None), (50, None, None, None, None, None, None, None, None), (51, "", "fr", "a", 0, 1.0, "", "", 1), (52, " \n", "fr", "a", 0, 1.0, "", "", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_language(spark, docs, rows):
    got = pipeline.language(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in got.collect()))) == sorted(str(r[0]) for r in rows if r[1] and r[1].strip())
    assert got.where("lang is null or score <> 0.5 and doc_id is not null").count() == 0


def test_line_dedup(spark, docs):
    got = pipeline.line_dedup(spark, docs, "")
    assert got.columns == docs.columns and got.where("doc_id in (50, 51, 52)").count() == 0
    assert got.where("n_chars <> length(text)").count() == 0 and got.where("doc_id is null").count() == 3


def test_simhash_dedup(spark, docs, rows):
    """Against every pair of texts; repeated rows leave one."""
    def runs(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets = [runs(r[1]) for r in rows]
    near = {(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    want = sorted(str(r[0]) for i, r in enumerate(rows) if not any(i in p for p in near))
    heads = {min((rows[i][0] is None, rows[i][0] or 0) for i in p) for p in near}
    want = sorted([*want, *(("None" if n else str(i)) for n, i in heads)])
    got = pipeline.simhash_dedup(spark, docs, "")
    assert got.columns == docs.columns and sorted(str(r["doc_id"]) for r in got.collect()) == want


def test_near_families(spark):
    """A family of more copies than are paired, and one that only meets over its second member."""
    draw = random.Random(3)
    own, other = words(draw, 200), words(draw, 200)
    texts = [" ".join([*own[:k], f"edit{k}", *own[k + 1 :]]) for k in range(1, 200, 4)] + [" ".join(other), " ".join([*other[:-20], *words(draw, 18)]), " ".join([*other[10:-20], *words(draw, 8)])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.near_classes(df).select("label").distinct().count() >= 1
    kept = {r["doc_id"] for r in simhash.without_near_copies(df).collect()}
    assert 0 in kept and 50 in kept and len(kept & set(range(50))) == 1
    assert simhash.without_near_copies(df.limit(0)).count() == 0


def test_near_chains(spark):
    """Chains of shifted texts, near their neighbours alone: lists compared from their first text join all that lists compared in full join, and only near texts."""
    draw, texts = random.Random(8), []
    for _ in range(8):
        own = words(draw, 260)
        texts += [" ".join(own[k : k + 160]) for k in range(0, 100, 8)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = lambda near: {r["doc_id"] for r in simhash.without_near_copies(df, near).collect()}
    led, full = kept(simhash.Near(triples=12, shared=1, paired=1)), kept(simhash.Near(triples=12, shared=1, paired=1000))
    assert set(range(0, len(texts), 13)) <= led <= full


def test_decontaminate_and_mix(spark, docs, rows, tmp_path):
    taken = " ".join(rows[0][1].split()[20:60])
    spark.createDataFrame([(7, taken), (7, "no such words"), (None, rows[2][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = pipeline.decontaminate(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and got.where("doc_id in (0, 100)").count() == 0 and got.count() < docs.count()
    mixed = pipeline.mix(spark, docs, str(tmp_path))
    assert set(docs.columns) <= set(mixed.columns) and mixed.where("taken <= 0").count() == 0 and mixed.where("sources = 's'").count() > 0


def test_run(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of these")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = pipeline.run(spark, str(tmp_path))
    assert 5 < out.count() < docs.count() and out.where(F.col("taken") > 2 * F.col("size")).count() == 0
