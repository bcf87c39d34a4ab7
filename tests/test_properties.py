"""Properties on generated rows; each example batch is one Spark frame."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import transactions
from riskflow.operators import (
    daily_aggregates,
    hash_split,
    window_aggregates,
    with_class_weight,
    with_risk_action,
    with_sequence,
)


def _random_rows(seed, n=500):
    rng = random.Random(seed)
    base = dt.datetime(2025, 3, 1)

    def time_text():
        if rng.random() < 0.05:
            return rng.choice(["garbage", None, ""])
        at = base + dt.timedelta(microseconds=rng.randrange(3 * 86_400_000_000))
        return at.strftime("%Y-%m-%dT%H:%M:%S.%fZ")

    def amount():
        return rng.choice([None, 0.0, rng.uniform(-10, 1000)])

    return [(time_text(), amount(), rng.choice([0, 0, 0, 1, None])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_totals_add_up(spark, seed):
    rows = _random_rows(seed)
    tx = transactions(spark, rows).repartition(1 + seed)
    scored = with_risk_action(tx.withColumn("Fraud_Probability", F.col("Amount") / 1000)).cache()
    timed = [r for r in rows if r[0] and r[0].endswith("Z")]

    daily = daily_aggregates(scored).collect()
    assert sum(r["total_transactions"] for r in daily) == len(timed)
    assert sum(r["total_fraud_transactions"] for r in daily) == sum(r[2] == 1 for r in timed)
    tiers = {r["Risk_Action"]: r["count"] for r in scored.groupBy("Risk_Action").count().collect()}
    assert sum(tiers.values()) == len(rows)

    windows = window_aggregates(scored).collect()
    assert sum(r["total_txn"] for r in windows) == 2 * len(timed)
    assert sum(r["fraud_count"] for r in windows) == 2 * sum(r[2] == 1 for r in timed)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_windows_match_brute_force(spark, seed):
    rows = _random_rows(seed, 200)
    want = {}
    for text, amount, label in rows:
        if not text or not text.endswith("Z"):
            continue
        at = dt.datetime.strptime(text, "%Y-%m-%dT%H:%M:%S.%fZ")
        pane = at.replace(minute=at.minute // 5 * 5, second=0, microsecond=0)
        for start in (pane, pane - dt.timedelta(minutes=5)):
            want.setdefault(start, []).append((amount, label))
    got = window_aggregates(transactions(spark, rows)).select(
        F.col("window.start").cast("timestamp_ntz").alias("start"), "*"
    )
    rows_by_start = {r["start"]: r for r in got.collect()}
    assert rows_by_start.keys() == want.keys()
    for start, members in want.items():
        amounts = [a for a, _ in members if a is not None]
        row = rows_by_start[start]
        assert row["total_txn"] == len(members)
        assert row["fraud_count"] == sum(label == 1 for _, label in members)
        assert row["avg_amount"] == (
            pytest.approx(sum(amounts) / len(amounts)) if amounts else None
        )


@pytest.mark.parametrize("seed", [4, 5])
def test_weights_and_split_and_sequence(spark, seed):
    rng = random.Random(seed)
    keys = rng.sample(range(-(2**40), 2**40), 800)
    df = spark.createDataFrame(
        [(k, int(rng.random() < 0.1)) for k in keys], "k long, Class int"
    ).repartition(seed)
    sums = with_class_weight(df).groupBy("Class").agg(F.sum("weight").alias("w")).collect()
    assert [r["w"] for r in sums] == pytest.approx([800.0, 800.0])
    train, test = hash_split(df, "k")
    assert sorted(r["k"] for r in train.unionByName(test).collect()) == sorted(keys)
    numbered = {r["k"]: r["sequence"] for r in with_sequence(df, ["k"]).collect()}
    assert numbered == {k: i for i, k in enumerate(sorted(keys))}
