"""Reproducible train/test split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.functions import split_position


def in_train(df: DataFrame, key: str | None = None, train: float = 0.8) -> Column:
    """Whether a row belongs to the training part.

    The part depends on the key alone, so it is the same under any
    partitioning and on any retry. Without a key column the whole row is the
    key; equal rows then fall on the same side.
    """
    position = split_position(F.xxhash64(*df.columns) if key is None else key)
    return position < train


def hash_split(
    df: DataFrame, key: str | None = None, train: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """Training and test part; a row with a null key goes to the test part."""
    chosen = F.coalesce(in_train(df, key, train), F.lit(False))
    return df.filter(chosen), df.filter(~chosen)
