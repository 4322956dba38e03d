"""Registered queries of the library, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from loomwell.plans import expression_queries, gene_queries, report_queries, text_queries

_MODULES = (expression_queries, gene_queries, report_queries, text_queries)
QUERIES: dict[str, Callable] = {k: q for m in _MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
