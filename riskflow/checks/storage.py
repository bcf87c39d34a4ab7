"""Checks of CSV and Parquet round trips, overwrite modes, tables and the view."""

from __future__ import annotations

import datetime as dt
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow import fixtures, plans, sinks, sources
from riskflow import operators as ops
from riskflow import schema as S
from riskflow import streaming as st
from riskflow.checks import sql
from riskflow.checks.batch import plain_time, rounded_daily
from riskflow.session import scratch_dir

# The later run of the overwrite checks starts at this day.
LATER = dt.date(2024, 1, 16)

# Days with at least this share of frauds; about half of the days have.
BAD_SHARE = 0.027


def _name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


def _stored_scored(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_dir(spark, "scored")
    sinks.write_scored(fixtures.tx(spark, sf_dir), path)
    return path


def src_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "csv")
    rows = fixtures.tx(spark, sf_dir).select(*S.TRAIN.names)
    rows.write.option("header", True).csv(path)
    return sources.read_history_csv(spark, path)


def src_parquet_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = sources.read_scored(spark, _stored_scored(spark, sf_dir))
    return stored.withColumn("event_ts", plain_time("event_ts"))


def src_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _name("scored")
    path = _stored_scored(spark, sf_dir)
    sources.register_partitioned(spark, name, S.SCORED, "Risk_Action", path)
    sources.repair_partitions(spark, name)
    table = sources.read_table(spark, name)
    return table.withColumn("event_ts", plain_time("event_ts"))


def src_sink_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view over the folder of a streaming sink."""
    name, paths = _name("scored"), st.StreamPaths(scratch_dir(spark, "stream"))
    scored = fixtures.tx_from_events(fixtures.events_stream(spark, sf_dir))
    check = paths.checkpoint("scored")
    st.write_scored_stream(scored, paths.scored, check, st.RUN_TO_COMPLETION).awaitTermination()
    sources.register_sink(spark, name, S.SCORED, paths.scored)
    view = sources.read_table(spark, name)
    return view.withColumn("event_ts", plain_time("event_ts"))


def sink_daily_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A static overwrite by a later, shorter run leaves only that run's days."""
    path = scratch_dir(spark, "daily")
    tx = fixtures.tx(spark, sf_dir)
    sinks.write_daily(ops.daily_aggregates(tx), path)
    sinks.write_daily(ops.daily_aggregates(_later(tx)), path)
    return rounded_daily(sources.read_daily(spark, path))


def sink_daily_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dynamic overwrite replaces the days of the later run and keeps the rest."""
    path = scratch_dir(spark, "daily")
    tx = fixtures.tx(spark, sf_dir)
    allowed = tx.filter(F.col("Risk_Action") == S.ALLOW)
    sinks.write_daily(ops.daily_aggregates(allowed), path)
    sinks.write_daily(ops.daily_aggregates(_later(tx)), path, dynamic=True)
    return rounded_daily(sources.read_daily(spark, path))


def _is_later():
    return F.col("event_ts") >= F.lit(LATER).cast("timestamp")


def _later(tx: DataFrame) -> DataFrame:
    return tx.filter(_is_later())


def daily_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily job from stored transactions to its repaired table."""
    name = _name("daily")
    plans.run_daily(spark, _stored_scored(spark, sf_dir), scratch_dir(spark, "daily"), name)
    return rounded_daily(sources.read_table(spark, name))


def catalog_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per partition right after the declaration and after the repair."""
    name = _name("scored")
    path = _stored_scored(spark, sf_dir)
    sources.drop_table(spark, name)
    sources.register_partitioned(spark, name, S.SCORED, "Risk_Action", path)
    rows_before = spark.table(name).count()
    sources.repair_partitions(spark, name)
    return sources.partition_counts(spark, name, "Risk_Action").withColumn(
        "rows_before_repair", F.lit(rows_before).cast("long")
    )


def catalog_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partitions a table lists after a shorter overwrite and a repair."""
    name, path, tx = _name("daily"), scratch_dir(spark, "daily"), fixtures.tx(spark, sf_dir)
    sinks.write_daily(ops.daily_aggregates(tx), path)
    sources.register_partitioned(spark, name, S.DAILY, "transaction_date", path)
    sources.repair_partitions(spark, name)
    sinks.write_daily(ops.daily_aggregates(_later(tx)), path)
    sources.repair_partitions(spark, name)
    return spark.sql(f"SHOW PARTITIONS {name}")


def daily_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the later days, from rows that lie in a folder per day."""
    path = scratch_dir(spark, "scored")
    sinks.write_scored(fixtures.tx_dirty(spark, sf_dir), path, by_day=True)
    daily = scratch_dir(spark, "daily")
    plans.run_daily(spark, path, daily, table=None, since=LATER)
    return rounded_daily(sources.read_daily(spark, daily))


def daily_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three runs over a folder that grows, each run reading the new files."""
    scored, daily, check = (scratch_dir(spark, name) for name in ("scored", "daily", "check"))
    tx = fixtures.tx_dirty(spark, sf_dir)
    for part in range(3):
        sinks.write_scored(tx.filter(F.col("event_id") % 3 == part), scored, mode="append")
        plans.run_daily_incremental(spark, scored, daily, check).awaitTermination()
    return rounded_daily(sources.read_daily(spark, daily))


def catalog_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partitions of a table that is told of changed folders only, and their totals."""
    name, tx = _name("daily"), fixtures.tx(spark, sf_dir)
    scored, daily, check = (scratch_dir(spark, name) for name in ("scored", "daily", "check"))
    for part in (tx.filter(~_is_later()), tx.filter(_is_later())):
        sinks.write_scored(part, scored, mode="append")
        plans.run_daily_incremental(spark, scored, daily, check, table=name).awaitTermination()
    sources.change_partitions(spark, name, "transaction_date", daily, gone=[LATER])
    return rounded_daily(sources.read_table(spark, name))


def sink_handover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a sink whose log has forgotten the older ones, which are in a table."""
    source, table, check = (scratch_dir(spark, name) for name in ("in", "table", "published"))
    paths = st.StreamPaths(scratch_dir(spark, "stream"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    scored, retention = paths.checkpoint("scored"), None
    with _compacting_every(spark, 3):
        for part in range(4):
            events.filter(F.col("event_id") % 4 == part).write.mode("append").parquet(source)
            stream = spark.readStream.schema(events.schema).parquet(source)
            tx = fixtures.tx_from_events(stream.withColumn("ts", F.col("ts").cast("timestamp")))
            st.write_scored_stream(
                tx, paths.scored, scored, st.RUN_TO_COMPLETION, retention=retention
            ).awaitTermination()
            written = time.monotonic()
            if part == 1:
                st.publish_scored(spark, paths.scored, table, check).awaitTermination()
                time.sleep(3)
            # The third batch rewrites the log; what the first two wrote is too old by then.
            retention = f"{int((time.monotonic() - written) * 1000)}ms" if part == 1 else None
    both = st.read_scored_of_both(spark, paths.scored, table, check)
    forgotten = spark.read.parquet(table).count() - _rows_also_in(spark, paths.scored, table)
    return both.withColumn("event_ts", plain_time("event_ts")).withColumn(
        "n_forgotten", F.lit(forgotten).cast("long")
    )


def _rows_also_in(spark: SparkSession, sink: str, table: str) -> int:
    """Rows of the table that the sink's log still names."""
    keys = ["Time", "V1"]
    named = sources.read_scored(spark, sink).select(*keys)
    return spark.read.parquet(table).join(named, keys, "left_semi").count()


@contextmanager
def _compacting_every(spark: SparkSession, batches: int):
    """Sink logs are rewritten, and forget, every so many batches."""
    name = "spark.sql.streaming.fileSink.log.compactInterval"
    before = spark.conf.get(name)
    spark.conf.set(name, batches)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def overview_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view over both tables."""
    scored_path, daily_path = _stored_scored(spark, sf_dir), scratch_dir(spark, "daily")
    plans.run_daily(spark, scored_path, daily_path, table=None)
    tx_name, daily_name, view = _name("scored"), _name("daily"), _name("overview")
    plans.setup_catalog(spark, scored_path, daily_path, tx_name, daily_name, view)
    return _plain_overview(sources.read_table(spark, view))


def overview_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of the days with many frauds only, from rows in a folder per day."""
    scored, daily = scratch_dir(spark, "scored"), scratch_dir(spark, "daily")
    tx = fixtures.tx(spark, sf_dir)
    sinks.write_scored(tx, scored, by_day=True)
    sinks.write_daily(ops.daily_aggregates(tx), daily)
    share = F.col("total_fraud_transactions") / F.col("total_transactions")
    bad_days = sources.read_daily(spark, daily).filter(share >= BAD_SHARE)
    return _plain_overview(ops.overview_of_days(sources.read_scored_days(spark, scored), bad_days))


def overview_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join as an operator, on rows of which some have no event time."""
    tx = fixtures.tx_dirty(spark, sf_dir)
    path = scratch_dir(spark, "daily")
    sinks.write_daily(ops.daily_aggregates(tx), path)
    return _plain_overview(ops.overview(tx, sources.read_daily(spark, path)))


def overview_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join as if the daily side were too large to broadcast."""
    tx = fixtures.tx_dirty(spark, sf_dir)
    path = scratch_dir(spark, "daily")
    sinks.write_daily(ops.daily_aggregates(tx), path)
    daily = sources.read_daily(spark, path)
    return _plain_overview(ops.overview(tx, daily, broadcast_rows=0))


def _plain_overview(joined: DataFrame) -> DataFrame:
    return joined.select(
        plain_time("event_ts"),
        "Amount",
        "Class",
        "Risk_Action",
        "total_transactions",
        "total_fraud_transactions",
        F.round("avg_amount", 9).alias("avg_amount"),
    )


QUERIES = {
    "src_csv": src_csv,
    "src_parquet_partitioned": src_parquet_partitioned,
    "src_table": src_table,
    "src_sink_view": src_sink_view,
    "sink_daily_overwrite": sink_daily_overwrite,
    "sink_daily_dynamic": sink_daily_dynamic,
    "daily_job": daily_job,
    "catalog_partitions": catalog_partitions,
    "catalog_sync": catalog_sync,
    "daily_since": daily_since,
    "daily_incremental": daily_incremental,
    "catalog_delta": catalog_delta,
    "sink_handover": sink_handover,
    "overview_join": overview_join,
    "overview_pruned": overview_pruned,
    "overview_operator": overview_operator,
    "overview_salted": overview_salted,
}


def _overview(dirty: bool) -> str:
    return (
        sql.tx(dirty)
        + f""", daily AS ({sql.daily()})
SELECT t.event_ts, t."Amount", t."Class", t."Risk_Action",
  d.total_transactions, d.total_fraud_transactions, d.avg_amount
FROM tx t LEFT JOIN daily d ON CAST(t.event_ts AS DATE) = d.transaction_date"""
    )


SQL = {
    "src_csv": sql.tx() + f" SELECT {', '.join(S.TRAIN.names)} FROM tx",
    "src_parquet_partitioned": sql.tx() + f" SELECT {sql.SCORED_COLUMNS} FROM tx",
    "src_table": sql.tx() + f" SELECT {sql.SCORED_COLUMNS} FROM tx",
    "src_sink_view": sql.tx() + f" SELECT {sql.SCORED_COLUMNS} FROM tx",
    "sink_daily_overwrite": sql.tx()
    + f", later AS (SELECT * FROM tx WHERE event_ts >= DATE '{LATER}') "
    + sql.daily("later"),
    "sink_daily_dynamic": sql.tx()
    + f""", later AS (SELECT * FROM tx WHERE event_ts >= DATE '{LATER}'),
earlier AS (SELECT * FROM tx WHERE event_ts < DATE '{LATER}' AND "Risk_Action" = 'ALLOW')
{sql.daily("later")} UNION ALL {sql.daily("earlier")}""",
    "daily_job": sql.tx() + sql.daily(),
    "catalog_partitions": sql.tx()
    + """ SELECT "Risk_Action", CAST(count(*) AS BIGINT) AS n_rows,
  CAST(0 AS BIGINT) AS rows_before_repair FROM tx GROUP BY 1""",
    "catalog_sync": sql.tx()
    + f""" SELECT DISTINCT 'transaction_date=' || CAST(event_ts AS DATE) AS "partition"
FROM tx WHERE event_ts >= DATE '{LATER}'""",
    "daily_since": sql.tx(dirty=True)
    + f", later AS (SELECT * FROM tx WHERE event_ts >= DATE '{LATER}') "
    + sql.daily("later"),
    "daily_incremental": sql.tx(dirty=True) + sql.daily(),
    "catalog_delta": sql.tx()
    + f", others AS (SELECT * FROM tx WHERE CAST(event_ts AS DATE) <> DATE '{LATER}') "
    + sql.daily("others"),
    "sink_handover": sql.tx()
    + f""" SELECT {sql.SCORED_COLUMNS}, (SELECT CAST(count(*) AS BIGINT) FROM events
  WHERE event_id % 4 < 2) AS n_forgotten FROM tx""",
    "overview_join": _overview(dirty=False),
    "overview_pruned": _overview(dirty=False)
    + f" WHERE d.total_fraud_transactions / d.total_transactions >= {BAD_SHARE}",
    "overview_operator": _overview(dirty=True),
    "overview_salted": _overview(dirty=True),
}
