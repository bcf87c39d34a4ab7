"""Tables and the overview view over stored data."""

from __future__ import annotations

from pyspark.sql import SparkSession

from riskflow import schema as S
from riskflow.sources.catalog import (
    create_overview,
    drop_table,
    is_streaming_sink,
    register_partitioned,
    register_sink,
    repair_partitions,
)


def setup_catalog(
    spark: SparkSession,
    scored_path: str,
    daily_path: str,
    scored_table: str = S.SCORED_TABLE,
    daily_table: str = S.DAILY_TABLE,
    view: str | None = S.OVERVIEW_VIEW,
) -> None:
    """Declare both tables anew, find their partitions, and add the overview.

    ``scored_path`` may be the folder of the streaming sink, which needs no
    copy, or one that a batch job wrote.
    """
    for name, schema, partition, path in (
        (scored_table, S.SCORED, "Risk_Action", scored_path),
        (daily_table, S.DAILY, "transaction_date", daily_path),
    ):
        drop_table(spark, name)
        if is_streaming_sink(spark, path):
            register_sink(spark, name, schema, path)
        else:
            register_partitioned(spark, name, schema, partition, path, if_not_exists=False)
            repair_partitions(spark, name)
    if view is not None:
        create_overview(spark, scored_table, daily_table, view)
