"""Settings of the flows, frozen; read from a mapping (the environment by default) with every value kept in its range."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Thresholds:
    """The defaults of the row rules; shares, points of distance, and amounts of money."""

    name_review_score: float = 0.78
    name_reject_score: float = 0.58
    quantity_warn_pct: float = 0.05
    quantity_critical_pct: float = 0.15
    price_warn_pct: float = 0.10
    price_critical_pct: float = 0.25
    price_warn_abs: float = 100_000.0
    price_critical_abs: float = 1_000_000.0
    component_warn_pct: float = 0.10
    component_critical_pct: float = 0.25
    robust_z_warn: float = 2.5
    robust_z_critical: float = 3.5
    min_bidders_for_consensus: int = 3


#: The range a setting is kept in; others are only kept from being negative.
RANGES = {"name_review_score": (0, 1), "name_reject_score": (0, 1), "min_bidders_for_consensus": (2, 100), "fuzzy_top_k": (1, 100), "row_reach": (1, 10_000), "max_rows": (1, 1_048_576)}


@dataclass(frozen=True)
class Settings:
    """thresholds of the rules; fuzzy_top_k neighbours a row; row_reach of the band join; max_rows of a sheet."""

    thresholds: Thresholds = Thresholds()
    fuzzy_top_k: int = 8
    row_reach: int = 35
    near_rows: int = 8
    max_rows: int = 1_000_000
    requirement_score: float = 0.66


def _kept(name: str, value, kind):
    try:
        value = kind(value)
    except (TypeError, ValueError):
        return None
    low, high = RANGES.get(name, (0, float("inf")))
    return None if value != value else kind(min(max(value, low), high))


def read_settings(values: Mapping[str, str] | None = None, prefix: str = "TALLYLOOM_") -> Settings:
    """Settings with what ``values`` has under prefix and the name in capitals; what is no number is left at its default."""
    values = os.environ if values is None else values

    def filled(held):
        found = {}
        for f in fields(held):
            kind = type(getattr(held, f.name))
            if kind in (int, float) and (raw := values.get(prefix + f.name.upper())) is not None and (got := _kept(f.name, raw, kind)) is not None:
                found[f.name] = got
        return replace(held, **found)

    return replace(filled(Settings()), thresholds=filled(Thresholds()))
