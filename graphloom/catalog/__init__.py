"""All queries of the graph engine by name, with their SQL."""

from __future__ import annotations

from graphloom.catalog import extraction, graphs, merging, retrieval, stored, texts, vectors  # noqa: F401  they register their queries
from graphloom.catalog.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
