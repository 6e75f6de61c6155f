"""The registered queries of this package and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("url_filter", "decontaminate", "mixing", "hyper_lang", "context_tree", "line_dedup", "token_counts", "simhash", "quality_rules", "licences")


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"{__package__}.{module}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE")
