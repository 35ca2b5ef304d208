"""Registry of the engine's queries and of their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskweave.sources.corpus import Frames, oracle_prelude

_QUERIES: dict[str, Callable[[Frames], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str = "") -> Callable:
    """Register a query over the frames; ``sql`` follows the common table expressions of its twin."""

    def keep(f: Callable[[Frames], DataFrame]) -> Callable[[Frames], DataFrame]:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def _load() -> None:
    from riskweave.plans import dashboards, documents, listings, maintenance, scraping  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(Frames(spark, sf_dir))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from riskweave.plans.views import VIEW_SQL

    _load()
    return {name: f"{oracle_prelude()},\n{VIEW_SQL}\n{sql}" for name, sql in _SQL.items()}
