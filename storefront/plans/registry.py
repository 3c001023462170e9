"""The named query catalogue.

Every entry binds one operator to the shop views over a driver directory and,
where the result is expressible in plain SQL, carries the independent SQL
twin (DuckDB dialect, shop views inlined as CTEs) that checks it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from storefront.plans.sqltext import with_views
from storefront.sources.views import ShopTables, shop_views

# Fixed clocks for the driver data (two time domains): orders span
# 1995-01-01..2001-08-01, events 2024-01-01..2024-01-30.
ORDERS_AS_OF = "2001-07-31 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
# Inside the events, whose orders exist: for reports on the last hour or day.
EVENTS_MIDWAY = "2024-01-15 12:00:00"


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[ShopTables], DataFrame]
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(t) -> DataFrame`` under ``name`` with its SQL twin."""
    def deco(fn: Callable[[ShopTables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, with_views(sql) if sql else None, (fn.__doc__ or "").strip())
        return fn
    return deco


def _load_all() -> None:
    # Importing the modules registers their queries.
    from storefront.plans import (  # noqa: F401
        q_changes, q_dashboard, q_enrich, q_media, q_payments, q_quality, q_sellers, q_streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {name: (lambda spark, sf_dir, _q=q: _q.build(shop_views(spark, sf_dir))) for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}
