"""Named queries: each is a Spark builder ``(spark, sf_dir) -> DataFrame`` and,
where SQL can express it, the DuckDB text of the same result (the oracle)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    ids: tuple[str, ...]  # SURVEY section-2 operator ids the query exercises


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None, ids: tuple[str, ...] = ()):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql, ids)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the plan modules fills QUERIES
    from gearsight.plans import alerts, fleet, model, reports, robot, series, storage  # noqa: F401
    from gearsight.streaming import queries as _sq  # noqa: F401
    return QUERIES
