import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import transactions, utc
from riskflow.operators import (
    daily_aggregates,
    preview,
    window_aggregates,
    window_anomalies,
    with_risk_action,
)
from riskflow.operators.aggregate import _windows


def _plain(windows):
    return windows.select(
        F.col("window.start").cast("timestamp_ntz").alias("start"),
        F.col("window.end").cast("timestamp_ntz").alias("end"),
        *[c for c in windows.columns if c != "window"],
    )


def _starts(spark, event_time):
    tx = transactions(spark, [(event_time, 1.0, 0)])
    return sorted(r["start"] for r in _plain(window_aggregates(tx)).collect())


def test_each_event_is_in_two_windows(spark):
    assert _starts(spark, "2025-01-01T00:07:00Z") == [
        utc("2025-01-01T00:00:00"),
        utc("2025-01-01T00:05:00"),
    ]


def test_window_start_is_inclusive_and_end_exclusive(spark):
    assert _starts(spark, "2025-01-01T00:10:00Z") == [
        utc("2025-01-01T00:05:00"),
        utc("2025-01-01T00:10:00"),
    ]


def test_no_event_time_means_no_window(spark):
    assert _starts(spark, "garbage") == []


def test_window_measures_with_nulls(spark):
    tx = transactions(
        spark,
        [
            ("2025-01-01T00:01:00Z", None, 1),
            ("2025-01-01T00:02:00Z", 4.0, None),
            ("2025-01-01T00:06:00Z", None, 0),
        ],
    )
    got = {r["start"]: r for r in _plain(window_aggregates(tx)).collect()}
    first = got[utc("2025-01-01T00:00:00")]
    assert (first["total_txn"], first["avg_amount"], first["fraud_count"]) == (3, 4.0, 1)
    last = got[utc("2025-01-01T00:05:00")]
    assert (last["total_txn"], last["avg_amount"], last["fraud_count"]) == (1, None, 0)


@pytest.mark.parametrize(
    ("length", "slide"),
    [
        ("10 minutes", "5 minutes"),
        ("5 minutes", "5 minutes"),
        ("1 hour", "5 minutes"),
        ("10 minutes", "4 minutes"),
        ("90 seconds", "1 minute"),
        ("1 week", "1 day"),
    ],
)
def test_panes_equal_direct_windows(spark, length, slide):
    base = dt.datetime(2025, 1, 1)
    rows = [
        ((base + dt.timedelta(seconds=37 * i)).isoformat() + "Z", float(i % 13), i % 2)
        for i in range(400)
    ]
    tx = transactions(spark, rows)
    got = _plain(window_aggregates(tx, length, slide)).collect()
    want = _plain(_windows(tx, length, slide)).collect()
    assert sorted(got) == sorted(want) and got


def test_anomaly_thresholds(spark):
    rows = [("2025-01-01T00:01:00Z", 501.0, 0)] + [("2025-01-01T01:31:00Z", 1.0, 0)] * 3
    tx = transactions(spark, rows)
    flags = {
        r["start"].hour: r["is_anomaly"] for r in _plain(window_anomalies(tx)).collect()
    }
    assert flags[0] is True and flags[1] is False
    low = {
        r["start"].hour: r["is_anomaly"]
        for r in _plain(window_anomalies(tx, max_total=2)).collect()
    }
    assert low[1] is True


def test_daily_totals(spark):
    tx = transactions(
        spark,
        [
            ("2025-01-01T23:59:59.999999Z", 10.0, 1),
            ("2025-01-01T00:00:00Z", None, None),
            ("2025-01-02T00:00:00Z", 5.0, 0),
            ("bad", 99.0, 1),
        ],
    )
    probabilities = F.when(F.col("Class") == 1, 0.9).when(F.col("Class") == 0, 0.4)
    scored = with_risk_action(tx.withColumn("Fraud_Probability", probabilities))
    got = {str(r["transaction_date"]): r for r in daily_aggregates(scored).collect()}
    assert set(got) == {"2025-01-01", "2025-01-02"}
    first = got["2025-01-01"]
    assert (first["total_transactions"], first["total_fraud_transactions"]) == (2, 1)
    assert (first["avg_amount"], first["max_amount"], first["min_amount"]) == (10.0, 10.0, 10.0)
    assert (first["total_blocked"], first["total_trigger_otp"]) == (1, 0)
    assert got["2025-01-02"]["total_trigger_otp"] == 1


def test_preview_is_the_first_rows_by_key(spark):
    df = spark.range(100).withColumn("k", F.lit(100) - F.col("id"))
    assert [r["k"] for r in preview(df, "k").collect()] == list(range(1, 11))
