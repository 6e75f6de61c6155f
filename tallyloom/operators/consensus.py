"""Whether the offers of several bidders say the same of an item."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import token_set_ratio, weighted_ratio
from ..functions.text import normalize_name


@lru_cache(maxsize=1 << 16)
def _alike(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    return (0.55 * weighted_ratio(a, b) + 0.45 * token_set_ratio(a, b)) / 100


def kinds_of(values: list[tuple[str, str]], threshold: float) -> tuple[int, list[float]]:
    """How many kinds there are among (text, normalised text), first come first, and each text's likeness to the nearest other kind."""
    heads: list[tuple[str, str]] = []
    for text, name in values:
        if all(_alike(name, other) < threshold for _, other in heads):
            heads.append((text, name))
    return len(heads), [max((_alike(name, other) for head, other in heads if head != text), default=0.0) for text, name in values]


def text_consensus(offers: DataFrame, item: str, bidder: str, text: str, threshold: float = 0.88, warning: bool = False) -> DataFrame:
    """(item, bidder, text, kinds, closest, severity, points) of the items on which bidders differ or some say nothing.

    Items of one offer, or of blank texts alone, agree. Texts are compared in
    the order of bidders. What a group sends to one task is its distinct
    texts, and only where there are several; the rest is settled by
    aggregates. Rows of a null item are left out.
    """
    said = offers.where(F.col(item).isNotNull()).select(F.col(item).alias("i__"), F.col(bidder).alias("b__"), F.trim(F.coalesce(text, F.lit(""))).alias("t__"))
    texts = said.groupBy("i__", "t__").agg(F.count(F.lit(1)).alias("n"), F.min("b__").alias("first"))
    filled = F.col("t__") != ""
    groups = texts.groupBy("i__").agg(F.sum("n").alias("offers"), F.count(F.when(filled, 1)).alias("texts"), F.max(~filled).alias("blank"))
    open_ = groups.where("offers >= 2 and texts >= 1 and (texts > 1 or blank)")
    several = texts.join(open_.where("texts > 1").select("i__"), "i__", "left_semi").withColumn("name", normalize_name(F.col("t__")))
    kind = offers.schema[item].dataType.simpleString()

    def judge(frame):
        frame = frame.sort_values(["first", "t__"])
        given = frame[frame["t__"] != ""]
        count, closest = kinds_of(list(zip(given["t__"], given["name"])), threshold)
        out = frame[["i__", "t__"]].assign(kinds=count, closest=0.0)
        out.loc[given.index, "closest"] = closest
        return out

    judged = several.groupBy("i__").applyInPandas(judge, f"i__ {kind}, t__ string, kinds int, closest double")
    both = said.join(open_.select("i__", "blank"), "i__").join(judged, ["i__", "t__"], "left").withColumn("kinds", F.coalesce("kinds", F.lit(1)))
    out = both.where("blank or kinds > 1")
    level, points = ("WARNING", 8.0) if warning else ("REVIEW", 4.0)
    return out.select(F.col("i__").alias(item), F.col("b__").alias(bidder), F.col("t__").alias(text), "kinds", F.coalesce("closest", F.lit(0.0)).alias("closest"), F.lit(level).alias("severity"), F.lit(points).alias("points"))
