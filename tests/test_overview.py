from pyspark.sql import functions as F

from helpers import physical_plan
from riskflow import schema as S
from riskflow.operators import daily_aggregates, overview
from riskflow.sinks import write_daily
from riskflow.sources import read_daily


def _tx(spark, n=3000):
    """A third of the rows on one day, some without a time, the rest spread."""
    day = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40)
    return spark.range(n).select(
        F.when(
            F.col("id") % 50 != 7,
            F.timestamp_seconds(F.lit(1_700_000_000) + day * 86400 + F.col("id") % 1000),
        ).alias("event_ts"),
        F.col("id").cast("double").alias("Amount"),
        (F.col("id") % 2).cast("int").alias("Class"),
        F.lit("ALLOW").alias("Risk_Action"),
    )


def test_broadcast_and_salted_join_agree(spark, folder):
    tx = _tx(spark)
    write_daily(daily_aggregates(tx), folder("daily"))
    daily = read_daily(spark, folder("daily"))
    small = overview(tx, daily)
    large = overview(tx, daily, broadcast_rows=0, salts=8)
    assert "BroadcastHashJoin" in physical_plan(small)
    assert sorted(small.collect(), key=str) == sorted(large.collect(), key=str)
    assert small.count() == 3000


def test_unmatched_rows_keep_nulls(spark):
    tx = _tx(spark, 10)
    rows = overview(tx, spark.createDataFrame([], S.DAILY)).collect()
    assert len(rows) == 10
    assert all(r["total_transactions"] is None and r["avg_amount"] is None for r in rows)


def test_salt_spreads_a_hot_day(spark, folder):
    tx = _tx(spark)
    write_daily(daily_aggregates(tx), folder("daily"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = overview(tx, read_daily(spark, folder("daily")), broadcast_rows=0, salts=64)
        sizes = [
            r["count"]
            for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
        ]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 3000
    assert max(sizes) < 1000
