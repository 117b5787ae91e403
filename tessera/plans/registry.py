"""Named queries over the Parquet tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tessera.session import run_sql

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query written in SQL; the oracle's text where DuckDB needs another."""
    _QUERIES[name] = partial(run_sql_query, text)
    _ORACLE[name] = oracle or text


def run_sql_query(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, text)


def register(name: str, query: Query, oracle: str) -> None:
    _QUERIES[name] = query
    _ORACLE[name] = oracle


def frame(name: str, oracle: str | None):
    """Decorate a query built with the DataFrame API."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _ORACLE[name] = oracle
        return f

    return add


def _load() -> None:
    from tessera.plans import dialect, relational, scalars, stateful, windowed  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
