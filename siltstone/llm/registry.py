"""All queries of the subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("substring_dedup", "quality", "topk", "exact_dedup", "toxicity", "packing", "token_counts", "mixing", "language_id", "near_dedup")


def _all(name: str) -> dict:
    out = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{m}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
