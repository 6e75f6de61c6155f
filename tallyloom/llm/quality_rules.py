"""Operator 9: quality statistics of whole texts and a learned decision list over them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import SPACE, UPPER, materialize, table, words

#: Ratios a condition may test, as SQL over the statistics.
FEATURES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "double(n_dup_lines)",
    "bang_rate": "n_bangs / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
}
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Learning:
    """sample: labelled rows learned from, those of the lowest hash; cuts: thresholds tried a feature."""

    sample: int = 20_000
    cuts: int = 64
    longest: int = 3
    most_rules: int = 12
    precision: float = 0.9
    least: int = 5


def _counted(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bangs, n_upper (long).

    Null and empty texts give zeros. The whole text counts, and a row stays a
    row whatever others repeat. Repeated windows are found by sorting the
    hashes of a text's own windows, so the cost of a text is n log n.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("t__", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(*keep, t.alias("t__")).select(
        *keep,
        words(F.col("t__")).alias("w__"),
        lines.alias("l__"),
        F.length(F.regexp_replace("t__", SPACE, "")).cast("long").alias("word_chars"),
        _counted(F.col("t__"), SYMBOLS).alias("n_symbols"),
        _counted(F.col("t__"), "!").alias("n_bangs"),
        _counted(F.col("t__"), UPPER).alias("n_upper"),
    )
    kept = [*keep, "word_chars", "n_symbols", "n_bangs", "n_upper"]
    base = base.select(
        *kept,
        F.size("w__").cast("long").alias("n_words"),
        (F.size("l__") - F.size(F.array_distinct("l__"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w__") >= 3, F.transform(F.sequence(F.lit(0), F.size("w__") - 3), lambda i: F.xxhash64(F.get("w__", i), F.get("w__", i + 1), F.get("w__", i + 2)))).alias("h__"),
    )
    kept += ["n_words", "n_dup_lines"]
    twice = F.size("h__") > F.size(F.array_distinct("h__"))
    base = base.select(*kept, F.when(twice, F.sort_array(F.transform("h__", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s__"))
    same = lambda s, k: F.coalesce(F.get("s__", k)["h"] == s["h"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter("s__", lambda s, k: same(s, k - 1) | same(s, k + 1)), lambda s: s["i"]))
    base = base.select(*kept, starts.alias("p__"))
    covered = F.aggregate(F.transform("p__", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("p__", k + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return base.select(*kept, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


# A rule is a tuple of (feature, ">" or "<=", threshold); it rejects where all hold.


def _covers(rule, columns: dict[str, np.ndarray]) -> np.ndarray:
    n = len(next(iter(columns.values())))
    return reduce(lambda m, c: m & (columns[c[0]] > c[2] if c[1] == ">" else columns[c[0]] <= c[2]), rule, np.ones(n, bool))


def _grow(columns, bad, cuts, longest) -> tuple:
    rule, inside = (), np.ones(len(bad), bool)
    while len(rule) < longest and (~bad[inside]).any():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best = (0.0, None)
        for name in sorted(columns):
            for cut in cuts[name]:
                for op in (">", "<="):
                    m = inside & _covers(((name, op, cut),), columns)
                    p, n = bad[m].sum(), (~bad[m]).sum()
                    if p and (gain := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > best[0] + 1e-12:
                        best = (gain, (name, op, float(cut)))
        if best[1] is None:
            break
        rule += (best[1],)
        inside = _covers(rule, columns)
    return rule


def _worth(rule, columns, bad) -> float:
    m = _covers(rule, columns)
    p, n = bad[m].sum(), (~bad[m]).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn_rules(columns: dict[str, np.ndarray], bad: np.ndarray, learning: Learning = Learning()) -> tuple:
    """Sequential covering: grow a conjunction by information gain on two thirds of the rows, prune its tail on the rest, keep it if precise, drop the rows it covers, go on."""
    rules: list[tuple] = []
    if not len(bad):
        return ()
    thirds = np.arange(len(bad)) % 3 == 2
    while len(rules) < learning.most_rules and bad[~thirds].any() and bad[thirds].any():
        grow = {k: v[~thirds] for k, v in columns.items()}
        prune = {k: v[thirds] for k, v in columns.items()}
        cuts = {k: np.unique(np.quantile(v, np.linspace(0, 1, learning.cuts + 1)[1:-1])) for k, v in grow.items()}
        full = _grow(grow, bad[~thirds], cuts, learning.longest)
        if not full:
            break
        rule = max((full[:k] for k in range(len(full), 0, -1)), key=lambda r: _worth(r, prune, bad[thirds]))
        m = _covers(rule, columns)
        right, checked = bad[m].sum(), _covers(rule, prune)
        if right < learning.least or right < learning.precision * m.sum() or bad[thirds][checked].sum() < learning.precision * checked.sum():
            break
        rules.append(rule)
        columns, bad, thirds = {k: v[~m] for k, v in columns.items()}, bad[~m], thirds[~m]
    return tuple(rules)


def rules_column(rules) -> Column:
    """The number of the first rule that fits, from 1; 0 where none does."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        fits = reduce(lambda a, b: a & b, [F.expr(FEATURES[f]) > cut if op == ">" else F.expr(FEATURES[f]) <= cut for f, op, cut in rule])
        out = F.when(fits, F.lit(k)).otherwise(out)
    return out


def labelled_sample(stats: DataFrame, labels: DataFrame, learning: Learning) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """At most ``learning.sample`` labelled rows that pass the base rules, ordered by hash; ids with two opinions take the lower quality."""
    told = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = stats.where(~F.col("base_failed")).join(told, "doc_id").select(F.xxhash64("doc_id").alias("o"), "doc_id", "quality", *[F.expr(e).alias(n) for n, e in FEATURES.items()])
    rows = materialize(rows, "labelled")
    part = min(1.0, 1.1 * learning.sample / max(1, rows.count()))  # so that a task sends its share, not a whole sample
    got = rows.where(F.col("o") <= min((1 << 63) - 1, int(-(1 << 63) + part * (1 << 64)))).orderBy("o", "doc_id").limit(learning.sample).collect()
    return {n: np.array([r[n] for r in got], float) for n in FEATURES}, np.array([r["quality"] == 0 for r in got], bool)


def quality_filter(docs: DataFrame, labels: DataFrame, learning: Learning = Learning()) -> DataFrame:
    """doc_id, the statistics, base_failed, rule (of the decision list, 0: none) and kept for every row of ``docs(doc_id, text)``.

    The list is learned from ``labels(doc_id, quality)``; without labels, or
    where no rule is precise enough, it is empty and only the base rules
    reject. A null text has no words and so fails. Repeated rows are judged
    alike; other columns are ignored.
    """
    stats = materialize(text_statistics(docs, "doc_id").withColumn("base_failed", base_failed()), "quality")
    rules = learn_rules(*labelled_sample(stats, labels, learning), learning)
    rule = rules_column(rules)
    out = stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (rule == 0)).alias("kept"), rule.alias("rule"), "n_bangs", "n_upper")
    return out


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_filter(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLE: dict[str, str] = {}
