"""All queries of the core and their SQL."""

from __future__ import annotations

from . import graph_queries, orphan_queries, source_queries, table_queries

_MODULES = [graph_queries, table_queries, orphan_queries, source_queries]


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
