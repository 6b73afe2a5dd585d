"""All queries over the driver tables, and their SQL."""

from __future__ import annotations

from . import audit_queries, function_queries, page_queries, store_queries, unit_queries

_MODULES = (page_queries, store_queries, unit_queries, function_queries, audit_queries)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
