"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module that has query(spark, sf_dir) and maybe ORACLE_SQL.
MODULES = {
    "op1_suffixes": "suffixes",
    "op2_licenses": "licenses",
    "op3_fingerprints": "fingerprints",
    "op4_pieces": "pieces",
    "op5_toxicity": "toxicity",
    "op6_sharding": "sharding",
    "op7_mixing": "mixing",
    "op8_urls": "urls",
    "op9_quality": "quality",
    "op10_simhash": "simhash",
}


def queries() -> dict:
    return {name: import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
