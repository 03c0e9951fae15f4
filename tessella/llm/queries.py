"""The queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

import importlib

#: Module and function of each query.
QUERIES = {
    "op8_licenses": "licenses",
    "op4_urls": "urls",
    "op10_topk": "topk",
    "op5_mixing": "mixing",
    "op3_neardup": "neardup",
    "op1_quality": "quality",
    "op7_pii": "pii",
    "op6_media": "media",
    "op2_secrets": "secrets",
    "op9_bpe": "bpe",
    "op11_variants": "variants",
    "op12_ann": "hashing",
    "op13_merkle": "merkle",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"tessella.llm.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"tessella.llm.{module}"), "ORACLE", {}).get(name) for name, module in QUERIES.items()}
    return {name: sql for name, sql in found.items() if sql}
