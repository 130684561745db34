"""The registered queries of this package and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["sharding", "syncmers", "secrets", "urlfilter", "packing", "langid",
           "decontamination", "simhash", "linededup", "katz", "lexical", "periodic", "oddsketch"]


def _gather(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(importlib.import_module(f"tabulith.llm.{module}"), name)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLES")
