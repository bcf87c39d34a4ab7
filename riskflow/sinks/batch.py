"""Parquet tables, message files and Kafka topics, written in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow import schema as S
from riskflow.operators.scored import scored_columns
from riskflow.sources.scored import read_scored


def write_daily(
    daily: DataFrame, path: str, mode: str = "overwrite", dynamic: bool = False
) -> None:
    """Daily totals, one folder per date.

    Overwriting replaces the whole folder, so dates that are not in ``daily``
    disappear. With ``dynamic`` only the dates in ``daily`` are replaced. The
    rows are not sorted: each date is a single row in its own folder.
    """
    (
        daily.write.mode(mode)
        .option("partitionOverwriteMode", "dynamic" if dynamic else "static")
        .partitionBy("transaction_date")
        .parquet(path)
    )


def write_scored(
    scored: DataFrame,
    path: str,
    mode: str = "overwrite",
    max_records_per_file: int = 0,
    by_day: bool = False,
    compact: bool = False,
) -> None:
    """Scored transactions, one folder per tier.

    Each task writes its own file in each tier it meets. There is no shuffle
    on the tier, because one tier holds most of the rows. With ``by_day`` there is a
    folder per UTC day below the tier, and rows are gathered by both before, so
    that a day does not get a file from every task; adaptive execution splits large
    days. ``compact`` gathers rows by tier alone, too, into few files.
    """
    rows, folders = scored.select(*scored_columns()), ["Risk_Action"]
    if by_day:
        folders.append(S.DAY)
        rows = rows.withColumn(S.DAY, F.to_date("event_ts"))
    if by_day or compact:
        rows = rows.hint("rebalance", *folders)
    (
        rows.write.mode(mode)
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy(*folders)
        .parquet(path)
    )


def copy_scored(
    spark: SparkSession, sink_path: str, table_path: str, by_day: bool = False
) -> None:
    """Publish a streaming sink's committed rows to a folder a table can sit on."""
    write_scored(read_scored(spark, sink_path), table_path, by_day=by_day)


def write_envelope_files(envelopes: DataFrame, path: str, mode: str = "append") -> None:
    """Messages as text files, one per line."""
    envelopes.select("value").write.mode(mode).text(path)


def kafka_sink_options(servers: str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic}


def write_kafka(envelopes: DataFrame, servers: str, topic: str) -> None:
    """Messages to a topic, from the executors; needs the Kafka connector."""
    envelopes.select("value").write.format("kafka").options(
        **kafka_sink_options(servers, topic)
    ).save()
