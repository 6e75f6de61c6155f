"""Comparing the offers of several suppliers for one item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import symmetric_pct

WARN, CRITICAL, WARN_SPAN, CRITICAL_SPAN = 0.10, 0.25, 1e5, 1e6


def spread_severity(spread: Column, span: Column, warn_span: float = WARN_SPAN, critical_span: float = CRITICAL_SPAN) -> Column:
    return F.when((spread >= CRITICAL) & (span >= critical_span), "CRITICAL").when((spread >= WARN) & (span >= warn_span), "WARNING").otherwise("OK")


def price_spread(offers: DataFrame, item: str, bidder: str, price: str) -> DataFrame:
    """One row an item: offers, lowest, exact median, highest, symmetric spread, who is lowest and highest, severity."""
    who = lambda sign: F.min(F.struct((sign * F.col(price)).alias("p"), F.col(bidder).alias("b")))["b"]
    out = offers.where(F.col(price).isNotNull()).groupBy(item).agg(F.count(F.lit(1)).alias("n"), F.min(price).alias("low"), F.median(price).alias("mid"), F.max(price).alias("high"), who(1).alias("low_bidder"), who(-1).alias("high_bidder"))
    spread = symmetric_pct(F.col("high"), F.col("low"))
    return out.withColumn("spread", spread).withColumn("severity", spread_severity(F.col("spread"), F.col("high") - F.col("low"), 100.0, 500.0))


def deviations(offers: DataFrame, item: str, price: str) -> DataFrame:
    """Every offer with its item's median and its symmetric deviation from it."""
    mid = F.median(price).over(Window.partitionBy(item))
    return offers.withColumn("mid", mid).withColumn("deviation", symmetric_pct(F.col(price), F.col("mid")))


def robust_z(offers: DataFrame, item: str, price: str, least: int = 3) -> DataFrame:
    """z by the median and 1.4826 MAD of items with ``least`` offers; a MAD of 0 counts as 1 % of the median, at least 1."""
    center = offers.groupBy(item).agg(F.median(price).alias("center"), F.count(price).alias("n")).where(F.col("n") >= least)
    held = offers.join(center, item)
    mad = held.groupBy(item).agg(F.median(F.abs(F.col(price) - F.col("center"))).alias("mad"))
    scale = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(F.greatest(F.abs("center") * 0.01, F.lit(1.0)))
    out = held.join(mad, item).withColumn("z", (F.col(price) - F.col("center")) / scale)
    return out.withColumn("severity", F.when(F.abs("z") >= 3.5, "CRITICAL").when(F.abs("z") >= 2.5, "WARNING").otherwise("OK"))


def price_matrix(offers: DataFrame, item: str, bidder: str, price: str, bidders: list) -> DataFrame:
    """One column a bidder with its mean price of the item."""
    return offers.groupBy(item).pivot(bidder, bidders).agg(F.avg(price))


def upper_median(values: Column) -> Column:
    """The upper of the two middle values of an array."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))
