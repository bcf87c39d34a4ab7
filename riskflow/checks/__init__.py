"""Queries over the test tables, one or more per operator, with SQL twins.

Every query reads a whole table. Where SQL can say the same, the twin runs in
DuckDB on the same Parquet files and must give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskflow.checks import batch, models, storage, streams
from riskflow.session import pin_settings

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (batch, storage, streams, models)


def _pinned(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(pin_settings(spark), sf_dir)

    run.__name__ = query.__name__
    run.__doc__ = query.__doc__
    return run


def all_queries() -> dict[str, Query]:
    return {name: _pinned(query) for module in _MODULES for name, query in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: text for module in _MODULES for name, text in module.SQL.items()}
