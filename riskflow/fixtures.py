"""Transactions derived from the ``events`` test table, clean and dirty.

See FIXTURES.md §3. The dirty form breaks one field in one row of 500 per
kind of fault; all rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow import schema as S
from riskflow.functions import iso_event_time, risk_action
from riskflow.operators.wire import to_envelope

EPOCH_2024 = 1704067200
BROKEN_JSON = "{broken"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with ``ts`` as an instant (stored without a zone)."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    return table.withColumn("ts", F.col("ts").cast("timestamp"))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as a stream.

    The glob matches only that one name; the file source takes a plain path
    for a folder, and here it may be a single file.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx_from_events(events(spark, sf_dir))


def tx_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx_from_events(events(spark, sf_dir), dirty=True)


def tx_from_events(source: DataFrame, dirty: bool = False) -> DataFrame:
    event_id = F.col("event_id")
    error = F.col("event_type") == "error"

    def unless(fault: int, value: Column, instead=None) -> Column:
        if not dirty:
            return value
        return F.when(event_id % 500 == fault, F.lit(instead)).otherwise(value)

    def feature(i: int) -> Column:
        noise = event_id * (7919 + 104 * i) % 1000 / F.lit(1000.0)
        signal = F.when(error, 1.0).otherwise(0.0) if i <= 4 else F.lit(0.0)
        value = noise + signal
        return unless(4, value) if i == 1 else value

    label = F.when(error & (F.col("value") > 100), 1).otherwise(0)
    stand_in = event_id * 37 % 1000 / F.lit(1000.0)
    return (
        source.select(
            "event_id",
            (F.unix_micros("ts") / F.lit(1e6) - F.lit(float(EPOCH_2024))).alias("Time"),
            unless(2, F.col("value")).alias("Amount"),
            unless(3, label).alias("Class"),
            unless(1, iso_event_time("ts"), "garbage").alias("eventTime"),
            # The value that parsing eventTime gives, as stored rows hold it.
            unless(1, F.col("ts")).alias("event_ts"),
            *[feature(i).alias(f"V{i}") for i in range(1, 29)],
            unless(5, stand_in).alias("Fraud_Probability"),
        )
        .withColumn("Risk_Action", risk_action("Fraud_Probability"))
    )


def messages(
    spark: SparkSession, sf_dir: str, dirty: bool = False, broken: bool = False
) -> DataFrame:
    """Messages of the whole table, encoded by every core.

    Encoding is slow next to reading, and a small table may be a single file.
    A table in at least as many pieces as there are cores is not shuffled.
    """
    rows, cores = events(spark, sf_dir), spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores)
    return envelopes(tx_from_events(rows, dirty), broken)


def envelopes(transactions: DataFrame, broken: bool = False) -> DataFrame:
    """Messages of the transactions, with ``event_id`` beside them.

    ``broken`` damages the text of one message in 500.
    """
    encoded = to_envelope(transactions.select("event_id", *S.WIRE.names), keep=["event_id"])
    if not broken:
        return encoded
    text = F.when(F.col("event_id") % 500 == 6, BROKEN_JSON).otherwise(F.col("value"))
    return encoded.withColumn("value", text)
