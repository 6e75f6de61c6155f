"""Locale-tolerant numbers and the comparisons built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that hold no number.
NOT_NUMBERS = ("", "-", "--", "—", "–", "n/a", "na", "none", "null", "nan")
CURRENCY = r"(?iu)(?<![\p{L}\d])(vnd|vnđ|đồng|dong|usd|eur)(?![\p{L}\d])|₫|\$"


def _one_separator(raw: Column, sep: str) -> Column:
    """Two parts: three digits after the mark are thousands unless only a zero stands before it; more parts: thousands if all have three digits."""
    parts = F.split(raw, f"[{sep}]")
    left, right, n = F.get(parts, 0), F.get(parts, 1), F.size(parts)
    two = F.when(left.isin("0", "") & F.length(right).between(1, 6), F.concat(F.when(left == "", "0").otherwise(left), F.lit("."), right))
    two = two.when(F.length(right) == 3, F.concat(left, right)).otherwise(F.concat(left, F.lit("."), right))
    many = F.when(F.forall(F.slice(parts, 2, 1_000), lambda p: F.length(p) == 3), F.array_join(parts, ""))
    many = many.otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), n - 1), ""), F.lit("."), F.element_at(parts, -1)))
    return F.when(n == 2, two).otherwise(many)


def parse_number(text: Column) -> Column:
    """1.234.567,89, 1,234,567.89, 1 234 567, (1.000) and -0.5 as doubles; null for anything with a letter."""
    raw = F.trim(F.replace(text, F.lit(" "), F.lit(" ")))
    none = F.lower(raw).isin(*NOT_NUMBERS)
    enclosed = raw.rlike(r"^\(.*\)$")
    body = F.regexp_replace(F.when(enclosed, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw), CURRENCY, "")
    letters = body.rlike(r"\p{L}")
    digits = F.regexp_replace(body, r"[^0-9,.\-+()]", "")
    sign = F.when(enclosed | F.startswith(digits, F.lit("-")), -1.0).otherwise(1.0)
    bare = F.regexp_replace(digits, r"^[+\-]", "")
    dots, commas = F.instr(bare, "."), F.instr(bare, ",")
    last = lambda mark: F.instr(F.reverse(bare), mark)
    both = F.when(last(",") < last("."), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(bare, F.lit(","), F.lit("")))
    normal = F.when((dots > 0) & (commas > 0), both).when(commas > 0, _one_separator(bare, ",")).when(dots > 0, _one_separator(bare, ".")).otherwise(bare)
    return F.when(~none & ~letters & normal.rlike(r"^[0-9]*\.?[0-9]+$|^[0-9]+\.$"), normal.try_cast("double") * sign)


def percent_delta(base: Column, value: Column) -> Column:
    return F.when(base == 0, F.when(value == 0, 0.0)).otherwise((value - base) / F.nullif(F.abs(base), F.lit(0.0)))


def symmetric_pct(value: Column, center: Column) -> Column:
    """Difference over the mean of the absolute values; 0 where both are 0."""
    return F.coalesce(F.try_divide(value - center, (F.abs(value) + F.abs(center)) / 2), F.when(value.isNotNull() & center.isNotNull(), 0.0))


def safe_amount(quantity: Column, price: Column, amount: Column) -> Column:
    return F.coalesce(amount, quantity * price)


def math_error(quantity: Column, price: Column, amount: Column, tolerance: float = 0.005) -> Column:
    """The difference of quantity x price and amount where it is above tolerance of the larger."""
    off, scale = F.abs(quantity * price - amount), F.greatest(F.abs(quantity * price), F.abs(amount), F.lit(1.0))
    return F.when(off / scale > tolerance, off)
