"""Queries by name, each beside the SQL that gives the same rows."""

from __future__ import annotations

from . import catalog_queries, file_queries, parse_queries, read_queries, series_queries, store_queries

MODULES = (catalog_queries, series_queries, store_queries, read_queries, file_queries, parse_queries)


def queries() -> dict:
    return {k: q for m in MODULES for k, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, (_, s) in m.QUERIES.items() if s}
