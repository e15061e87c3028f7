"""Named queries of the library over the driver's tables."""

from __future__ import annotations

from longspan.queries import attach, base, metrics, models, robust, sources, windows
from longspan.queries.windows import flagship_weekly_panel as flagship

__all__ = ["attach", "flagship", "oracle_sql", "metrics", "models", "queries", "robust", "sources", "windows"]


def queries():
    return dict(base.QUERIES)


def oracle_sql():
    return dict(base.SQL)
