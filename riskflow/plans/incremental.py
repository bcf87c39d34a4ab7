"""Daily totals kept up to date by the rows that are new since the last run."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskflow import schema as S
from riskflow.operators.partials import daily_from_partials, daily_partials, merge_partials
from riskflow.sinks.batch import write_daily
from riskflow.sources.catalog import change_partitions, register_partitioned
from riskflow.sources.scored import read_sink_stream
from riskflow.storage import finished, remove_folder
from riskflow.streaming.sinks import RUN_TO_COMPLETION

#: Beside the checkpoint: a state per batch, of one row per day.
_STATE = r"batch=(\d+)"


def _state_path(checkpoint: str) -> str:
    return f"{checkpoint}-state"


def run_daily_incremental(
    spark: SparkSession,
    scored_path: str,
    daily_path: str,
    checkpoint: str,
    table: str | None = None,
    max_files: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start bringing the daily totals up to date; by default the query ends when they are.

    The scored folder is followed as a stream: a run opens only files that no run
    before has counted, whichever days their rows are of, so rows that come late
    change the totals of their old day. What those rows add up to is merged into a
    state of one row per day, and only the days that changed are written (and, with
    ``table``, added to its partitions).

    The state of a batch is made from the state before it, which is kept until the
    next but one. A batch that failed anywhere and is repeated therefore gives the
    same state and the same totals. A new checkpoint counts everything again; give
    it a daily folder of its own, or one whose days it will all replace.
    """
    update = partial(_update, daily_path, _state_path(checkpoint), table)
    rows = read_sink_stream(spark, scored_path, max_files)
    return (
        rows.writeStream.foreachBatch(update)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or RUN_TO_COMPLETION))
        .start()
    )


def daily_state(spark: SparkSession, checkpoint: str) -> DataFrame | None:
    """The latest whole state; None before the first batch."""
    folder = _state_path(checkpoint)
    latest = finished(spark, folder, _STATE)
    return spark.read.parquet(f"{folder}/batch={latest[-1]}") if latest else None


def _update(daily_path: str, states: str, table: str | None, rows: DataFrame, batch: int) -> None:
    spark = rows.sparkSession
    fresh = daily_partials(rows).withColumn("changed_in", F.lit(batch).cast("long"))
    whole = [number for number in finished(spark, states, _STATE) if number < batch]
    if whole:
        old = spark.read.parquet(f"{states}/batch={whole[-1]}")
        fresh = merge_partials(old.unionByName(fresh), latest=["changed_in"])
    path = f"{states}/batch={batch}"
    # One file of a few rows; the totals before it are still made by many tasks.
    fresh.repartition(1).write.mode("overwrite").parquet(path)

    changed = spark.read.parquet(path).filter(F.col("changed_in") == batch)
    write_daily(daily_from_partials(changed), daily_path, dynamic=True)
    if table is not None:
        days = [row[0] for row in changed.select("transaction_date").collect()]
        register_partitioned(spark, table, S.DAILY, "transaction_date", daily_path)
        change_partitions(spark, table, "transaction_date", daily_path, present=days)
    for number in whole[:-1]:
        remove_folder(spark, f"{states}/batch={number}")
