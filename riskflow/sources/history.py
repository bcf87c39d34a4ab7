"""Labelled history from CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskflow import schema as S


def read_history_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = S.TRAIN,
    infer: bool = False,
) -> DataFrame:
    """CSV with a header line.

    With a schema the file is read once, when needed, and a header that does
    not match raises instead of shifting columns. ``infer`` guesses the types
    at the price of an extra pass over the data.
    """
    reader = spark.read.option("header", True)
    if infer:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).option("enforceSchema", False).csv(path)
