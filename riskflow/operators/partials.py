"""Daily totals as partial states, which can be merged in any order and grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow import schema as S
from riskflow.operators.wire import drop_missing_event_ts

_COUNTS = ["total_transactions", "total_fraud_transactions", "total_blocked", "total_trigger_otp"]


def daily_partials(scored: DataFrame) -> DataFrame:
    """One row per UTC day: what :func:`daily_from_partials` needs of these rows.

    The average is kept as sum and number of the amounts there are.
    """
    action = F.col("Risk_Action")
    return (
        drop_missing_event_ts(scored)
        .groupBy(F.to_date("event_ts").alias("transaction_date"))
        .agg(
            F.count(F.lit(1)).alias("total_transactions"),
            F.count_if(F.col(S.LABEL) == 1).alias("total_fraud_transactions"),
            F.count_if(action == S.BLOCK_CARD).alias("total_blocked"),
            F.count_if(action == S.TRIGGER_OTP).alias("total_trigger_otp"),
            F.sum("Amount").alias("sum_amount"),
            F.count("Amount").alias("n_amount"),
            F.max("Amount").alias("max_amount"),
            F.min("Amount").alias("min_amount"),
        )
    )


def merge_partials(partials: DataFrame, latest: Sequence[str] = ()) -> DataFrame:
    """One state per day out of several; of the columns ``latest`` the greatest value."""
    sums = [*_COUNTS, "sum_amount", "n_amount"]
    return partials.groupBy("transaction_date").agg(
        *[F.sum(name).alias(name) for name in sums],
        *[F.max(name).alias(name) for name in ["max_amount", *latest]],
        F.min("min_amount").alias("min_amount"),
    )


def daily_from_partials(partials: DataFrame) -> DataFrame:
    """The daily totals of merged states."""
    average = F.try_divide("sum_amount", "n_amount").alias("avg_amount")
    return partials.withColumn("avg_amount", average).select(*S.DAILY.names)
