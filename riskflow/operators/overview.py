"""Transactions next to the totals of their day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import schema as S

BROADCAST_ROWS = 200_000

# Output of the overview, from the transaction side and from the daily side.
TX_COLUMNS = ["event_ts", "Amount", "Class", "Risk_Action"]
DAILY_COLUMNS = ["total_transactions", "total_fraud_transactions", "avg_amount"]


def overview(
    tx: DataFrame,
    daily: DataFrame,
    broadcast_rows: int = BROADCAST_ROWS,
    salts: int | None = None,
) -> DataFrame:
    """Every transaction, left-joined to its day; no match leaves nulls.

    ``daily`` holds one row per date and should be a stored table: its rows
    are counted first (a read of Parquet footers). Up to ``broadcast_rows`` it
    is broadcast and the transactions do not move. Beyond that both sides are
    shuffled on the date and a salt, so that a day with a third of all
    transactions, or the rows without a date, spread over ``salts`` tasks, by
    default as many as a shuffle has partitions.
    """
    if salts is None:
        salts = int(tx.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = tx.select(*TX_COLUMNS, F.to_date("event_ts").alias("transaction_date"))
    right = daily.select("transaction_date", *DAILY_COLUMNS)
    if right.count() <= broadcast_rows:
        joined = left.join(F.broadcast(right), "transaction_date", "left")
    else:
        joined = _salted_left_join(left, right, "transaction_date", salts)
    return joined.select(*TX_COLUMNS, *DAILY_COLUMNS)


def overview_of_days(tx: DataFrame, daily: DataFrame, day: str = S.DAY) -> DataFrame:
    """The transactions of just the days that ``daily`` still has, beside their totals.

    ``tx`` lies in a folder per day, named by ``day``, and ``daily`` is filtered on its
    totals. Which days pass is known only when the query runs; Spark then hands them to
    the scan of the transactions, so the folders of all other days are not opened.
    ``daily`` is broadcast: it holds a row per day, and is counted first.
    """
    chosen = daily.select(F.col("transaction_date").alias(day), *DAILY_COLUMNS)
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    return tx.join(chosen, day).select(*TX_COLUMNS, *DAILY_COLUMNS)


def _salted_left_join(left: DataFrame, right: DataFrame, key: str, salts: int) -> DataFrame:
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    copies = copies.hint("shuffle_hash")  # no sort of the transactions
    salted = left.withColumn("_salt", _row_salt(left.columns, salts))
    return salted.join(copies, [key, "_salt"], "left")


def _row_salt(columns: list[str], salts: int) -> Column:
    """A salt taken from the row itself: a retried task deals rows out the same way."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")
