"""Checking SQL for the registered queries, run by DuckDB on the same parquet files."""

from __future__ import annotations

import importlib
import pkgutil

from oracle.builder import build

_HELPERS = {"builder"}


def oracle_queries() -> dict[str, str]:
    steps: dict[str, str] = {}
    queries: dict[str, str] = {}
    for module in pkgutil.iter_modules(__path__):
        if module.name not in _HELPERS:
            part = importlib.import_module(f"oracle.{module.name}")
            steps.update(part.STEPS)
            queries.update(part.QUERIES)
    return {name: build(text, steps) for name, text in queries.items()}
