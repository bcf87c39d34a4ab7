"""Risk rules as plain column expressions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

from riskflow import schema as S


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def fraud_probability(probability: Column | str = "probability") -> Column:
    """Probability of class 1 from a classifier's probability vector, null for null."""
    vector = _col(probability)
    # vector_to_array raises on null, so it must not see one.
    return F.when(vector.isNotNull(), F.get(vector_to_array(vector), 1))


def risk_action(
    probability: Column | str = "Fraud_Probability",
    block: float = S.BLOCK_THRESHOLD,
    otp: float = S.OTP_THRESHOLD,
) -> Column:
    """Tier of a probability; both bounds are inclusive.

    A null falls through to ALLOW. NaN sorts above every number in Spark and
    is therefore blocked.
    """
    p = _col(probability)
    return F.when(p >= block, S.BLOCK_CARD).when(p >= otp, S.TRIGGER_OTP).otherwise(S.ALLOW)


def is_high_risk(action: Column | str = "Risk_Action") -> Column:
    return _col(action).isin(S.BLOCK_CARD, S.TRIGGER_OTP)


def is_anomaly(
    total: Column | str = "total_txn",
    average: Column | str = "avg_amount",
    max_total: float = S.MAX_WINDOW_TXN,
    max_average: float = S.MAX_WINDOW_AVG,
) -> Column:
    """True above either threshold (strictly), false otherwise and for nulls."""
    busy_or_large = (_col(total) > max_total) | (_col(average) > max_average)
    return F.coalesce(busy_or_large, F.lit(False))
