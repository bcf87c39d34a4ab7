"""Class balance and the row weights that even it out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from riskflow import schema as S


def class_balance(df: DataFrame, label: str = S.LABEL) -> DataFrame:
    """Total, fraud and non-fraud rows in one pass; a null label is not fraud."""
    counted = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col(label) == 1).alias("fraud_rows"),
    )
    return counted.withColumn("non_fraud_rows", F.col("total_rows") - F.col("fraud_rows"))


def class_weights(df: DataFrame, label: str = S.LABEL) -> DataFrame:
    """The balance and the weights under which each class weighs as much as all rows.

    Fails, naming the class, if one of the two has no rows.
    """

    def weight(rows: str, name: str):
        missing = F.raise_error(F.lit(f"cannot weight classes: no {name} rows")).cast("double")
        return F.when(F.col(rows) == 0, missing).otherwise(F.col("total_rows") / F.col(rows))

    return class_balance(df, label).withColumns(
        {
            "weight_fraud": weight("fraud_rows", "fraud"),
            "weight_non_fraud": weight("non_fraud_rows", "non-fraud"),
        }
    )


def with_class_weight(
    df: DataFrame, label: str = S.LABEL, weights: Row | Mapping[str, float] | None = None
) -> DataFrame:
    """Add ``weight`` by label.

    Weights come from all of ``df`` unless given. As a scalar subquery they
    are computed inside the same query; a caller that scans ``df`` repeatedly
    passes the row of :func:`class_weights` in to compute them once.
    """
    if weights is None:
        computed = class_weights(df, label)
        fraud = computed.select("weight_fraud").scalar()
        non_fraud = computed.select("weight_non_fraud").scalar()
    else:
        fraud = F.lit(weights["weight_fraud"])
        non_fraud = F.lit(weights["weight_non_fraud"])
    return df.withColumn("weight", F.when(F.col(label) == 1, fraud).otherwise(non_fraud))
