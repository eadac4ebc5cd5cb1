"""Registered queries over the reference's operators, with their SQL."""

from __future__ import annotations

from . import answers, documents, ingestion, retrieval, storage

FLAGSHIP = "bm25_topk"
_PLANS = (retrieval, storage, documents, answers, ingestion)


def queries() -> dict:
    return {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _PLANS for name, sql in plan.SQL.items()}
