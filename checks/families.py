"""All registered queries, family by family."""

from __future__ import annotations

import importlib
import importlib.util

FAMILIES = [
    "scalars", "inference", "filters", "aggregation", "sources", "retrieval", "questions",
    "catalog", "edits",
]


def _modules():
    for name in FAMILIES:
        if importlib.util.find_spec(f"checks.{name}"):
            yield importlib.import_module(f"checks.{name}")


def queries() -> dict:
    return {k: q for m in _modules() for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _modules() for k, q in m.ORACLES.items()}
