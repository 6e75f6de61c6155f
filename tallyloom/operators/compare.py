"""Differences between matched rows, versions, and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percent_delta

RANK = ("OK", "INFO", "REVIEW", "WARNING", "CRITICAL")


def numeric_difference(base: Column, value: Column, warn: float, critical: float, warn_abs: float = 0.0, critical_abs: float = 0.0, one_sided: str = "REVIEW", ceiling: Column | None = None) -> Column:
    """Severity of a number against its base, null where there is nothing to report; ``ceiling`` is the worst that a deviation may be."""
    pct, off = F.abs(percent_delta(base, value)), F.abs(value - base)
    worst = F.lit("CRITICAL") if ceiling is None else ceiling
    level = F.when((pct >= critical) & (off >= critical_abs), worst).when((pct >= warn) & (off >= warn_abs), "WARNING")
    zero = F.when(value != 0, F.when((worst == "CRITICAL") & F.lit(critical_abs > 0) & (off >= critical_abs), "CRITICAL").otherwise("WARNING"))
    return F.when(base.isNull() & value.isNull(), None).when(base.isNull() | value.isNull(), one_sided).when(base == 0, zero).otherwise(level)


def changed(old: Column, new: Column) -> Column:
    """A number changed by more than 0.5 or a billionth of it; a number on one side alone counts if it is not 0."""
    one = F.coalesce(old, new)
    return F.when(old.isNull() & new.isNull(), False).when(old.isNull() | new.isNull(), one != 0).otherwise(F.abs(new - old) > F.greatest(F.lit(0.5), 1e-9 * F.abs(old)))


def version_status(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Full outer join of two versions: added, removed, changed or unchanged, with the fields that changed."""
    a, b = old.select(key, *[F.col(f).alias(f"old_{f}") for f in fields]).withColumn("in_old", F.lit(True)), new.select(key, *[F.col(f).alias(f"new_{f}") for f in fields]).withColumn("in_new", F.lit(True))
    both = a.join(b, key, "full_outer")
    which = F.array_compact(F.array(*[F.when(changed(F.col(f"old_{f}"), F.col(f"new_{f}")), F.lit(f)) for f in fields]))
    both = both.withColumn("fields", F.when(F.col("in_old") & F.col("in_new"), which).otherwise(F.array().cast("array<string>")))
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.size("fields") > 0, "changed").otherwise("unchanged")
    return both.withColumn("status", status).drop("in_old", "in_new")
