"""All registered queries of the library's own operators, and the SQL that checks them."""

from __future__ import annotations

from notelake.plans import graph_queries, index_queries, note_queries, product_queries, search_queries

MODULES = (index_queries, graph_queries, search_queries, product_queries, note_queries)
flagship = index_queries.flagship


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
