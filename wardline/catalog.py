"""All queries of the library and their SQL."""

from __future__ import annotations

from wardline.plans import cascade_queries, file_queries, page_queries, resolution, spatial, stream_queries, table_queries, text_queries  # noqa: F401
from wardline.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
