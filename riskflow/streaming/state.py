"""Windows that a query still holds open, read from its state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.operators.aggregate import WINDOW_STATE
from riskflow.storage import child_names, highest_number

_WINDOWS = (
    "window struct<start:timestamp,end:timestamp>, total_txn long, avg_amount double, "
    "fraud_count long"
)


def open_windows(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """The windows in a window query's state after its last (or an earlier) whole batch.

    They are what the query has counted so far in windows that the watermark has not
    passed. The state is read in as many tasks as it has partitions, without touching
    the running query or its input. A query that has not finished a batch has none.
    """
    if highest_number(spark, f"{checkpoint}/commits", r"(\d+)") is None:
        return spark.createDataFrame([], _WINDOWS)
    reader = spark.read.format("statestore")
    if batch is not None:
        reader = reader.option("batchId", batch)
    # Buffers of two aggregates share a name, so they are named by place.
    held = F.col("value").cast(WINDOW_STATE)
    return reader.load(checkpoint).select(
        "key.window",
        held["total_txn"].alias("total_txn"),
        F.try_divide(held["sum_amount"], held["n_amount"]).alias("avg_amount"),
        held["fraud_count"].alias("fraud_count"),
    )


def current_windows(spark: SparkSession, sink: str, checkpoint: str) -> DataFrame:
    """Closed windows of the sink and open ones of the state, told apart by ``is_open``.

    A window that is written while this is read may be in both; the closed one counts.
    """
    still = open_windows(spark, checkpoint).withColumn("is_open", F.lit(True))
    if not child_names(spark, sink):
        return still
    closed = spark.read.parquet(sink).select(*still.columns[:-1]).withColumn("is_open", F.lit(False))
    return closed.unionByName(still.join(closed.select("window"), "window", "left_anti"))
