"""Words of the language model: counted and looked up where they are read."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import context_tree

TEXTS = ["A b\x0ba\tÉa  c\x1cd", "a b a b", "b c\r\nC c É", None, "", " \n", "a b a b"]


def cut(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("held", [1, 1000])
def test_word_counts(spark, held):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(2)
    got = {bytes(r["word"]).decode(): r["c"] for r in context_tree.word_counts(df, held).collect()}
    assert got == collections.Counter(w for t in TEXTS for w in cut(t)) and "c\x1cd" in got


@pytest.mark.parametrize("head", [0, 2, 1000])
def test_word_scores_by_lookup_and_join(spark, head):
    """The same whether words are looked up or joined."""
    rows = [(k if k < 6 else 1, t) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = collections.Counter(w for t in TEXTS[:3] for w in cut(t))
    out, totals = context_tree.word_scores(df, df.where(F.col("doc_id") < 3).distinct(), context_tree.Tree(head=head))
    got = {r["doc_id"]: (r["n_tokens"], r["known"], round(r["logs"], 9)) for r in out.collect()}
    assert got == {k: (len(cut(t)) + 1, sum(w in counts for w in cut(t)), round(sum(math.log10(counts[w] + 1) for w in cut(t) if w in counts), 9)) for k, t in rows[:6]}
    assert totals.first()["n"] == sum(counts.values()) + 3 and totals.first()["v"] == len(counts) + 1
