"""Registered queries by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
PLANS = ("sessions", "measures", "preparation", "texts", "dialogues", "relational", "policies", "signals", "streams", "assistant", "releases", "reports", "sources", "replies")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a function of (spark, sf_dir) as a query, with DuckDB SQL for its rows."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries named {name}")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for plan in PLANS:
        import_module(f"relspark.plans.{plan}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relspark.plans.sessions import temporal_states

    return temporal_states(spark, sf_dir).groupBy("state").count()


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
