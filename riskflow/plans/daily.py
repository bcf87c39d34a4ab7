"""Daily totals: compute, store, declare and repair."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import SparkSession

from riskflow import schema as S
from riskflow.operators.aggregate import daily_aggregates
from riskflow.sinks.batch import write_daily
from riskflow.sources.catalog import register_partitioned, repair_partitions
from riskflow.sources.scored import read_scored


def run_daily(
    spark: SparkSession,
    scored_path: str,
    daily_path: str,
    table: str | None = S.DAILY_TABLE,
    since: dt.date | None = None,
    repair: Sequence[str] = (),
) -> None:
    """Write the daily totals, then declare and repair their table.

    A full run replaces the whole folder. ``since`` limits the run to that
    UTC day and later ones: where scored rows lie in a folder per day, earlier
    folders are not opened, elsewhere the bound skips row groups in the Parquet
    scan; only the recomputed days are replaced. ``repair`` names further tables to
    repair afterwards.
    """
    scored = read_scored(spark, scored_path, since)
    write_daily(daily_aggregates(scored), daily_path, dynamic=since is not None)
    if table is not None:
        register_partitioned(spark, table, S.DAILY, "transaction_date", daily_path)
    for name in [*([table] if table else []), *repair]:
        repair_partitions(spark, name)
