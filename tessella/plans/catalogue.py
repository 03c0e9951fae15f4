"""All queries of the library, by name."""

from __future__ import annotations

import importlib

#: Modules of this package that hold queries; each has QUERIES (name to function) and ORACLE (name to DuckDB SQL).
MODULES: list[str] = ["vectors", "tags", "glyphs", "feedback", "evaluation", "paths", "files"]


def _modules() -> list:
    return [importlib.import_module(f"tessella.plans.{name}") for name in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in _modules() for k, sql in m.ORACLE.items()}
