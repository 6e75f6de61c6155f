"""Fuzzy string ratios in [0, 100], by the insert-and-delete distance; Arrow batches, each distinct pair once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine integer a row."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * _common(a, b) / total


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter against every window of its length, cut short at both ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    return max(ratio(a, b[max(0, k) : k + n]) for k in range(1 - n, len(b)))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _sets(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_set_ratio(a: str, b: str) -> float:
    if not a.split() or not b.split():
        return 0.0
    both, left, right = _sets(a, b)
    if both and not (left and right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(ratio(one, two), *((ratio(both, one), ratio(both, two)) if both else (0.0,)))


def partial_token_ratio(a: str, b: str) -> float:
    both, left, right = _sets(a, b)
    if both:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(left, right))


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        return max(ratio(a, b), 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if longer <= 8 else 0.6
    return max(ratio(a, b), scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def _column(fn):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a.fillna(""), b.fillna("")):
            if pair not in seen:
                seen[pair] = fn(*pair)
            out.append(seen[pair])
        return pd.Series(out, dtype="float64")

    return run


ratio_column, partial_column, token_set_column, weighted_column = map(_column, (ratio, partial_ratio, token_set_ratio, weighted_ratio))


@F.pandas_udf(T.DoubleType())
def text_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """0.55 weighted and 0.45 token-set ratio, of 1; 1 if both are blank, 0 if one is."""
    each = (1.0 if not x and not y else 0.0 if not x or not y else (0.55 * weighted_ratio(x, y) + 0.45 * token_set_ratio(x, y)) / 100 for x, y in zip(a.fillna(""), b.fillna("")))
    return pd.Series(list(each), dtype="float64")
