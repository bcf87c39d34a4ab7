"""Checks of scalar rules, projections, aggregates, windows, split and replay."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow import fixtures, ml
from riskflow import operators as ops
from riskflow import schema as S
from riskflow.checks import sql
from riskflow.functions import iso_event_time
from riskflow.operators.wire import CORRUPT, REASON

# The default thresholds never fire on the test events.
MAX_TOTAL = 5
MAX_AVERAGE = 150

REPLAY_START = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)


def plain_time(column: str, alias: str | None = None):
    """A timestamp without zone, the type the SQL side returns."""
    return F.col(column).cast("timestamp_ntz").alias(alias or column)


def plain_windows(windows: DataFrame) -> DataFrame:
    others = [c for c in windows.columns if c not in ("window", "avg_amount")]
    return windows.select(
        plain_time("window.start", "window_start"),
        plain_time("window.end", "window_end"),
        F.round("avg_amount", 9).alias("avg_amount"),
        *others,
    )


def rounded_daily(daily: DataFrame) -> DataFrame:
    return daily.withColumn("avg_amount", F.round("avg_amount", 9))


def event_ts_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = ops.with_event_ts(fixtures.tx_dirty(spark, sf_dir).drop("event_ts"))
    return parsed.select("event_id", plain_time("event_ts"))


def iso_event_time_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.events(spark, sf_dir).select(
        "event_id", iso_event_time("ts").alias("eventTime")
    )


def json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = fixtures.events(spark, sf_dir).withColumn("value", F.col("props").cast("binary"))
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    return ops.parse_wire(messages, schema, keep=["event_id"])


def risk_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = fixtures.tx_dirty(spark, sf_dir).drop("Risk_Action")
    return ops.with_risk_action(dirty).select("event_id", "Fraud_Probability", "Risk_Action")


def scored_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    projected = fixtures.tx(spark, sf_dir).select(*ops.scored_columns())
    return projected.withColumn("event_ts", plain_time("event_ts"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.alerts(fixtures.tx(spark, sf_dir), keep=["event_id"])


def quarantine_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = fixtures.messages(spark, sf_dir, dirty=True, broken=True)
    parsed = ops.parse_wire(messages, keep=["event_id", "value"], corrupt=CORRUPT)
    labelled = ops.label_faults(ops.with_event_ts(parsed), "value")
    return labelled.select(
        "event_id",
        (~ops.is_rejected()).alias("scored"),
        F.coalesce(REASON, F.lit("ok")).alias("reason"),
    )


def daily_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_daily(ops.daily_aggregates(fixtures.tx(spark, sf_dir)))


def daily_aggregates_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_daily(ops.daily_aggregates(fixtures.tx_dirty(spark, sf_dir)))


def daily_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = ops.daily_aggregates(fixtures.tx(spark, sf_dir))
    return rounded_daily(ops.preview(daily, "transaction_date"))


def sliding_window_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_windows(ops.window_aggregates(fixtures.tx_dirty(spark, sf_dir)))


def window_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = ops.window_anomalies(
        fixtures.tx(spark, sf_dir), max_total=MAX_TOTAL, max_average=MAX_AVERAGE
    )
    return plain_windows(flagged)


def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.class_balance(fixtures.tx_dirty(spark, sf_dir))


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.class_weights(fixtures.tx(spark, sf_dir))


def class_weight_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = ops.with_class_weight(fixtures.tx_dirty(spark, sf_dir))
    return weighted.select("event_id", "Class", F.round("weight", 9).alias("weight"))


def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = ops.hash_split(fixtures.tx(spark, sf_dir).select("event_id"), "event_id")
    return train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )


def auc_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fixtures.tx(spark, sf_dir).select("Fraud_Probability", S.LABEL)
    area = ml.auc(scored, score="Fraud_Probability")
    return spark.range(1).select(F.round(F.lit(area), 9).alias("auc"))


def replay_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = ops.replay_selection(fixtures.tx(spark, sf_dir), ["event_id"])
    return chosen.select("event_id", "replay_group", "Class", "Amount")


def replay_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = fixtures.tx(spark, sf_dir).select("event_id", S.LABEL)
    return ops.replay_sequence(chosen, ["event_id"]).select("event_id", "sequence")


def replay_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = ops.replay_envelopes(
        fixtures.tx(spark, sf_dir), ["event_id"], REPLAY_START, keep=["event_id"]
    )
    return ops.parse_wire(messages, keep=["event_id"])


def event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events numbered in the order of their time; the id makes it unique."""
    numbered = ops.with_sequence(
        fixtures.events(spark, sf_dir).select("event_id", "ts"), ["ts", "event_id"], unique=True
    )
    return numbered.select("event_id", "sequence")


def wire_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = fixtures.messages(spark, sf_dir, dirty=True)
    return ops.parse_wire(messages, keep=["event_id"])


QUERIES = {
    "event_ts_parse": event_ts_parse,
    "iso_event_time": iso_event_time_text,
    "json_parse": json_parse,
    "risk_tier": risk_tier,
    "scored_projection": scored_projection,
    "alerts": alerts,
    "quarantine_reasons": quarantine_reasons,
    "daily_aggregates": daily_aggregates,
    "daily_aggregates_dirty": daily_aggregates_dirty,
    "daily_preview": daily_preview,
    "sliding_window_batch": sliding_window_batch,
    "window_anomaly": window_anomaly,
    "class_balance": class_balance,
    "class_weights": class_weights,
    "class_weight_rows": class_weight_rows,
    "train_test_split": train_test_split,
    "auc_score": auc_score,
    "replay_selection": replay_selection,
    "replay_sequence": replay_sequence,
    "replay_envelopes": replay_envelopes,
    "event_sequence": event_sequence,
    "wire_roundtrip": wire_roundtrip,
}

_REPLAY = """, replayed AS (
  SELECT *, CASE WHEN "Class" = 1 THEN 0 ELSE 1 END AS replay_group,
    CAST(row_number() OVER (ORDER BY "Class" DESC, event_id) - 1 AS BIGINT) AS sequence
  FROM tx
)"""

_WIRE_WITHOUT_TIME = ", ".join(f'"{c}"' for c in S.WIRE.names if c != "eventTime")

SQL = {
    "event_ts_parse": sql.tx(dirty=True) + " SELECT event_id, event_ts FROM tx",
    "iso_event_time": sql.tx() + ' SELECT event_id, "eventTime" FROM tx',
    "json_parse": """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k
FROM events""",
    "risk_tier": sql.tx(dirty=True)
    + ' SELECT event_id, "Fraud_Probability", "Risk_Action" FROM tx',
    "scored_projection": sql.tx() + f" SELECT {sql.SCORED_COLUMNS} FROM tx",
    "alerts": sql.tx()
    + """ SELECT event_id, "eventTime", "Amount", "Fraud_Probability", "Risk_Action"
FROM tx WHERE "Fraud_Probability" >= 0.4""",
    "quarantine_reasons": sql.tx(dirty=True)
    + """, labelled AS (
  SELECT event_id, CASE WHEN event_id % 500 = 6 THEN 'bad_json'
    WHEN "Amount" IS NULL OR "V1" IS NULL THEN 'bad_feature'
    WHEN event_ts IS NULL THEN 'bad_event_time' ELSE 'ok' END AS reason
  FROM tx)
SELECT event_id, reason NOT IN ('bad_json', 'bad_feature') AS scored, reason FROM labelled""",
    "daily_aggregates": sql.tx() + sql.daily(),
    "daily_aggregates_dirty": sql.tx(dirty=True) + sql.daily(),
    "daily_preview": sql.tx() + sql.daily() + " ORDER BY transaction_date LIMIT 10",
    "sliding_window_batch": sql.tx(dirty=True) + sql.sliding(),
    "window_anomaly": sql.tx()
    + f""" SELECT *, coalesce(total_txn > {MAX_TOTAL} OR avg_amount > {MAX_AVERAGE}, false)
  AS is_anomaly FROM ({sql.sliding()})""",
    "class_balance": sql.tx(dirty=True)
    + """ SELECT CAST(count(*) AS BIGINT) AS total_rows,
  CAST(count(*) FILTER ("Class" = 1) AS BIGINT) AS fraud_rows,
  CAST(count(*) - count(*) FILTER ("Class" = 1) AS BIGINT) AS non_fraud_rows FROM tx""",
    "class_weights": sql.tx()
    + """, counted AS (
  SELECT CAST(count(*) AS BIGINT) AS total_rows,
    CAST(count(*) FILTER ("Class" = 1) AS BIGINT) AS fraud_rows FROM tx)
SELECT total_rows, fraud_rows, total_rows - fraud_rows AS non_fraud_rows,
  total_rows / fraud_rows AS weight_fraud,
  total_rows / (total_rows - fraud_rows) AS weight_non_fraud FROM counted""",
    "class_weight_rows": sql.tx(dirty=True)
    + """, counted AS (
  SELECT count(*) AS n, count(*) FILTER ("Class" = 1) AS frauds FROM tx)
SELECT event_id, "Class",
  round(CASE WHEN "Class" = 1 THEN n / frauds ELSE n / (n - frauds) END, 9) AS weight
FROM tx, counted""",
    "train_test_split": """SELECT event_id,
  CASE WHEN ((event_id % 2147483648) * 2654435761) % 4294967296 < 0.8 * 4294967296
    THEN 'train' ELSE 'test' END AS part FROM events""",
    "auc_score": sql.tx()
    + """, by_score AS (
  SELECT "Fraud_Probability" AS p, count(*) FILTER ("Class" = 1) AS pos,
    count(*) FILTER ("Class" = 0) AS neg FROM tx GROUP BY 1),
ranked AS (
  SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING), 0) AS below FROM by_score)
SELECT round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg))::DOUBLE, 9) AS auc
FROM ranked""",
    "replay_selection": sql.tx()
    + _REPLAY
    + """ SELECT event_id, CAST(replay_group AS INTEGER) AS replay_group, "Class", "Amount"
FROM replayed""",
    "replay_sequence": sql.tx() + _REPLAY + " SELECT event_id, sequence FROM replayed",
    "replay_envelopes": sql.tx()
    + f""" SELECT event_id, {_WIRE_WITHOUT_TIME},
  strftime(TIMESTAMP '2025-01-01' + to_microseconds(CAST(round("Time" * 1e6) AS BIGINT)),
    '%Y-%m-%dT%H:%M:%S.%fZ') AS "eventTime" FROM tx""",
    "event_sequence": """SELECT event_id,
  CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS sequence FROM events""",
    "wire_roundtrip": sql.tx(dirty=True) + f" SELECT event_id, {sql.WIRE_COLUMNS} FROM tx",
}
