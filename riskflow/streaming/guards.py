"""Refuse to start a sink with a checkpoint that is not its own."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from riskflow.storage import highest_number, read_small, write_small

FILE_SINK_LOG = ("_spark_metadata", r"(\d+)(?:\.compact)?")
BATCH_FOLDERS = ("", r"batch_id=(\d+)")

#: Beside a sink's output: the id of the query that writes it.
OWNER = "_owner"


class StaleCheckpointError(RuntimeError):
    """The sink belongs to another query than the checkpoint."""


def guard_sink(
    spark: SparkSession, path: str, checkpoint: str, written: tuple[str, str]
) -> None:
    """Compare the query that owns the sink with the one the checkpoint is of.

    A file sink skips every batch number it has already committed, and the
    alert sink replaces it. Under a new or foreign checkpoint the same numbers
    stand for other rows, so starting would lose some or mix two queries.

    A sink without an owner, from before owners were noted or from a start that
    failed at once, is listed: it must not hold a later batch than the checkpoint.
    """
    owner = read_small(spark, f"{path}/{OWNER}")
    if owner is not None:
        metadata = read_small(spark, f"{checkpoint}/metadata")
        query = json.loads(metadata)["id"] if metadata else None
        if query != owner.strip():
            raise StaleCheckpointError(
                f"{path} is written by query {owner.strip()}, but {checkpoint} is of "
                f"{query or 'none yet'}; use the sink's own checkpoint, or a new output folder"
            )
        return
    folder, pattern = written
    in_sink = highest_number(spark, f"{path}/{folder}" if folder else path, pattern)
    if in_sink is None:
        return
    planned = highest_number(spark, f"{checkpoint}/offsets", r"(\d+)")
    if planned is None or planned < in_sink:
        raise StaleCheckpointError(
            f"{path} holds batch {in_sink}, but the last batch of {checkpoint} is {planned}; "
            "use the sink's own checkpoint, or a new output folder"
        )


def claim_sink(spark: SparkSession, path: str, query: StreamingQuery) -> StreamingQuery:
    """Note which query writes the sink, at its first start."""
    if read_small(spark, f"{path}/{OWNER}") is None:
        write_small(spark, f"{path}/{OWNER}", query.id)
    return query
