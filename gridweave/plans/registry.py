"""All registered queries and their SQL."""

from __future__ import annotations

from gridweave.plans import collection_queries, graph_queries, retention_queries, source_queries, sweep_queries  # noqa: F401  they register
from gridweave.plans.base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
