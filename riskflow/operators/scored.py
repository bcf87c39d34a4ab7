"""Projections of scored transactions: table rows, alerts and alert cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import schema as S
from riskflow.functions import alert_key, is_high_risk, risk_action


def scored_columns() -> list[Column]:
    """The columns of the scored table, each exactly once and in its table type."""
    return [F.col(f.name).cast(f.dataType).alias(f.name) for f in S.SCORED.fields]


def with_risk_action(
    df: DataFrame, block: float = S.BLOCK_THRESHOLD, otp: float = S.OTP_THRESHOLD
) -> DataFrame:
    return df.withColumn("Risk_Action", risk_action("Fraud_Probability", block, otp))


def alerts(scored: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """High-risk transactions, in the columns an alert carries."""
    return scored.filter(is_high_risk("Risk_Action")).select(*keep, *S.ALERT_COLUMNS)


def with_alert_key(df: DataFrame, id_columns: Sequence[str]) -> DataFrame:
    return df.withColumn("alert_key", alert_key(id_columns))


def plain_number(name: str) -> Column:
    """A double as the shortest decimal text, without an exponent from 1e-4 up to 1e16.

    Spark's own text has one from 1e7 on and below 1e-3. Outside that range, and for
    NaN and infinity, its text stays.
    """
    value = F.col(name)
    digits = F.rtrim(value.cast("decimal(38,20)").cast("string"), F.lit("0"))
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    size = F.abs(value)
    exponent = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
    return F.when(exponent, plain).otherwise(value.cast("string"))


def alert_cells(alert_rows: DataFrame) -> DataFrame:
    """Row key and text cells of the wide-column alert layout; null stays null."""
    kinds = dict(alert_rows.dtypes)
    cells = [
        (plain_number(name) if kinds[name] == "double" else F.col(name).cast("string")).alias(name)
        for name in S.ALERT_COLUMNS
    ]
    return alert_rows.select("alert_key", *cells)
