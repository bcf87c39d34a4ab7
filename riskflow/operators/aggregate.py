"""Daily totals and sliding-window aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow import schema as S
from riskflow.functions import is_anomaly
from riskflow.operators.wire import drop_missing_event_ts


def daily_aggregates(scored: DataFrame) -> DataFrame:
    """One row per UTC day: counts, amounts and tiers.

    Every aggregate has a map-side partial form, so a day that holds most of
    the rows still shuffles one row per map task.
    """
    action = F.col("Risk_Action")
    return (
        drop_missing_event_ts(scored)
        .groupBy(F.to_date("event_ts").alias("transaction_date"))
        .agg(
            F.count(F.lit(1)).alias("total_transactions"),
            F.count_if(F.col(S.LABEL) == 1).alias("total_fraud_transactions"),
            F.avg("Amount").alias("avg_amount"),
            F.max("Amount").alias("max_amount"),
            F.min("Amount").alias("min_amount"),
            F.count_if(action == S.BLOCK_CARD).alias("total_blocked"),
            F.count_if(action == S.TRIGGER_OTP).alias("total_trigger_otp"),
        )
    )


def preview(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows by ``key``; a top-k, so nothing is sorted globally."""
    return df.orderBy(key).limit(n)


def window_aggregates(
    tx: DataFrame,
    length: str = S.WINDOW_LENGTH,
    slide: str = S.WINDOW_SLIDE,
    watermark: str = S.WATERMARK,
) -> DataFrame:
    """Count, average amount and fraud count per sliding window of event time.

    A streaming input is watermarked, so in append mode a window is emitted
    once, when the watermark passes its end. A bounded input needs no
    watermark and yields every window.
    """
    if tx.isStreaming:
        return _windows(tx.withWatermark("event_ts", watermark), length, slide)
    if _overlap_evenly(length, slide):
        return _windows_from_panes(tx, length, slide)
    return _windows(tx, length, slide)


def _overlap_evenly(length: str, slide: str) -> bool:
    """Whether each window consists of several whole slides."""
    try:
        whole, step = pd.Timedelta(length), pd.Timedelta(slide)
    except ValueError:  # a unit that only Spark knows, such as weeks
        return False
    return whole > step and whole % step == pd.Timedelta(0)


#: What a window query keeps of a window, in the order of the aggregates below.
WINDOW_STATE = "struct<total_txn:long, sum_amount:double, n_amount:long, fraud_count:long>"


def _windows(tx: DataFrame, length: str, slide: str) -> DataFrame:
    return tx.groupBy(F.window("event_ts", length, slide)).agg(
        F.count(F.lit(1)).alias("total_txn"),
        F.avg("Amount").alias("avg_amount"),
        F.count_if(F.col(S.LABEL) == 1).alias("fraud_count"),
    )


def _windows_from_panes(tx: DataFrame, length: str, slide: str) -> DataFrame:
    """Aggregate rows once into slide-wide panes, then panes into windows.

    A direct sliding window copies each row length/slide times before the
    aggregation. Here only panes are copied, and there are few of those.
    """
    panes = tx.groupBy(F.window("event_ts", slide).alias("pane")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("Amount").alias("amount"),
        F.count("Amount").alias("n_amount"),
        F.count_if(F.col(S.LABEL) == 1).alias("n_fraud"),
    )
    return panes.groupBy(F.window("pane.start", length, slide)).agg(
        F.sum("n").alias("total_txn"),
        F.try_divide(F.sum("amount"), F.sum("n_amount")).alias("avg_amount"),
        F.sum("n_fraud").alias("fraud_count"),
    )


def with_anomaly_flag(
    windows: DataFrame,
    max_total: float = S.MAX_WINDOW_TXN,
    max_average: float = S.MAX_WINDOW_AVG,
) -> DataFrame:
    return windows.withColumn(
        "is_anomaly", is_anomaly("total_txn", "avg_amount", max_total, max_average)
    )


def window_anomalies(
    tx: DataFrame,
    length: str = S.WINDOW_LENGTH,
    slide: str = S.WINDOW_SLIDE,
    watermark: str = S.WATERMARK,
    max_total: float = S.MAX_WINDOW_TXN,
    max_average: float = S.MAX_WINDOW_AVG,
) -> DataFrame:
    """Window aggregates with the anomaly flag."""
    windows = window_aggregates(tx, length, slide, watermark)
    return with_anomaly_flag(windows, max_total, max_average)
