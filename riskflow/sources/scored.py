"""Scored transactions and daily totals at rest."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow import schema as S
from riskflow.sources.envelopes import ANY_AGE
from riskflow.storage import child_names


def read_scored(spark: SparkSession, path: str, since: dt.date | None = None) -> DataFrame:
    """Scored transactions with the tier recovered from the directory names.

    Reading by path honours the commit log of a streaming sink, so files of an
    unfinished batch are never seen and new partitions need no repair. Folders of
    rejected messages are left out. ``since`` keeps that UTC day and later ones:
    where rows lie in a folder per day, only those folders are listed and opened.
    """
    return scored_rows(spark, path, since)


def scored_rows(
    spark: SparkSession,
    path: str,
    since: dt.date | None = None,
    files: Sequence[str] | None = None,
) -> DataFrame:
    """The same of only some of the files below ``path``."""
    folders = []
    if any(name.startswith(f"{S.OUTCOME}=") for name in child_names(spark, path)):
        folders.append(T.StructField(S.OUTCOME, T.StringType()))
    if since is not None:
        folders.append(T.StructField(S.DAY, T.DateType()))
    reader = spark.read.schema(T.StructType([*S.SCORED.fields, *folders]))
    if files is None:
        stored = reader.parquet(path)
    else:
        stored = reader.option("basePath", path).parquet(*files)
    if S.OUTCOME in stored.columns:
        stored = stored.filter(F.col(S.OUTCOME) == S.IS_SCORED)
    if since is not None:
        # Rows outside day folders have no day; the time bound decides for them.
        recent = F.col(S.DAY).isNull() | (F.col(S.DAY) >= F.lit(since))
        stored = stored.filter(recent).filter(F.col("event_ts") >= F.lit(since).cast("timestamp"))
    return stored.select(*S.SCORED.names)


def _file_stream(
    spark: SparkSession,
    schema: T.StructType,
    path: str,
    max_file_age: str = ANY_AGE,
    max_files: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFileAge", max_file_age)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(path)


def read_scored_days(spark: SparkSession, path: str) -> DataFrame:
    """Scored transactions from a folder per day, with the day as a column that prunes folders."""
    folders = T.StructType([*S.SCORED.fields, T.StructField(S.DAY, T.DateType())])
    return spark.read.schema(folders).parquet(path)


def read_stored_stream(
    spark: SparkSession, path: str, max_file_age: str = ANY_AGE, **bounds
) -> DataFrame:
    """All that the scoring query stored, as a stream, for jobs that follow it.

    ``outcome`` tells scored rows from rejected messages; a filter on it, or on the
    tier, opens only the folders it names. ``max_files`` or ``max_bytes`` bound what
    one micro-batch takes of a backlog.
    """
    return _file_stream(spark, S.STORED, path, max_file_age, **bounds)


def read_sink_stream(
    spark: SparkSession, path: str, max_files: int | None = None
) -> DataFrame:
    """The scored rows of a scored sink as a stream, with or without rejected messages beside."""
    if any(name.startswith(f"{S.OUTCOME}=") for name in child_names(spark, path)):
        stored = read_stored_stream(spark, path, max_files=max_files)
        return stored.filter(F.col(S.OUTCOME) == S.IS_SCORED).select(*S.SCORED.names)
    return _file_stream(spark, S.SCORED, path, max_files=max_files)


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.DAILY).parquet(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
