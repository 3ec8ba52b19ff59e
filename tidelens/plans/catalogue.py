"""The queries by name, each with the SQL that checks it."""

from __future__ import annotations

from tidelens.plans import archive_queries, display_queries, match_queries, scene_queries, source_queries, stream_queries  # noqa: F401
from tidelens.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
