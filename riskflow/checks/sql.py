"""Shared SQL: the fixture transactions as common table expressions."""

from __future__ import annotations

from riskflow import schema as S

TIER = """CASE WHEN "Fraud_Probability" >= 0.7 THEN 'BLOCK_CARD'
             WHEN "Fraud_Probability" >= 0.4 THEN 'TRIGGER_OTP' ELSE 'ALLOW' END"""

WIRE_COLUMNS = ", ".join(f'"{name}"' for name in S.WIRE.names)
SCORED_COLUMNS = ", ".join(f'"{name}"' for name in S.SCORED.names)


def tx(dirty: bool = False) -> str:
    """A WITH clause that defines ``tx``, clean or dirty."""

    def unless(fault: int, value: str, instead: str = "NULL") -> str:
        if not dirty:
            return value
        return f"CASE WHEN event_id % 500 = {fault} THEN {instead} ELSE {value} END"

    def feature(i: int) -> str:
        value = f"(event_id * {7919 + 104 * i} % 1000) / 1000.0::DOUBLE"
        if i <= 4:
            value += " + CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
        return unless(4, value) if i == 1 else value

    label = "CASE WHEN event_type = 'error' AND value > 100 THEN 1 ELSE 0 END"
    time_text = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"
    features = ",\n  ".join(f'{feature(i)} AS "V{i}"' for i in range(1, 29))
    stand_in = "(event_id * 37 % 1000) / 1000.0::DOUBLE"
    return f"""WITH fields AS (
  SELECT event_id, ts,
  epoch_us(ts) / 1e6 - 1704067200::DOUBLE AS "Time",
  {unless(2, "value")} AS "Amount",
  CAST({unless(3, label)} AS INTEGER) AS "Class",
  {unless(1, time_text, "'garbage'")} AS "eventTime",
  {features},
  {unless(5, stand_in)} AS "Fraud_Probability"
  FROM events
), tx AS (
  SELECT *, {TIER} AS "Risk_Action",
  try_cast(replace("eventTime", 'Z', '') AS TIMESTAMP) AS event_ts
  FROM fields
)"""


def daily(source: str = "tx") -> str:
    """Totals per day over ``source``."""
    return f"""SELECT CAST(event_ts AS DATE) AS transaction_date,
  CAST(count(*) AS BIGINT) AS total_transactions,
  CAST(count(*) FILTER ("Class" = 1) AS BIGINT) AS total_fraud_transactions,
  round(avg("Amount"), 9) AS avg_amount,
  max("Amount") AS max_amount,
  min("Amount") AS min_amount,
  CAST(count(*) FILTER ("Risk_Action" = 'BLOCK_CARD') AS BIGINT) AS total_blocked,
  CAST(count(*) FILTER ("Risk_Action" = 'TRIGGER_OTP') AS BIGINT) AS total_trigger_otp
  FROM {source} WHERE event_ts IS NOT NULL GROUP BY 1"""


def sliding(source: str = "tx") -> str:
    """Ten-minute windows every five minutes over ``source``."""
    return f"""SELECT window_start, window_start + INTERVAL 10 MINUTE AS window_end,
  CAST(count(*) AS BIGINT) AS total_txn,
  round(avg("Amount"), 9) AS avg_amount,
  CAST(count(*) FILTER ("Class" = 1) AS BIGINT) AS fraud_count
  FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, event_ts) - k * INTERVAL 5 MINUTE AS window_start
        FROM {source}, (VALUES (0), (1)) AS shift(k) WHERE event_ts IS NOT NULL)
  GROUP BY window_start"""
