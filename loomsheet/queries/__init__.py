"""All queries of the core, module by module, with their SQL."""

from __future__ import annotations

import importlib

MODULES = ("problems", "document", "spreadsheet", "functions", "analysis")


def _modules():
    return [importlib.import_module(f"loomsheet.queries.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _modules() for k, s in m.SQL.items()}
