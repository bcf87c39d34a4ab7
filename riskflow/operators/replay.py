"""History as messages: which rows, in which order, with which event time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow import schema as S
from riskflow.operators.sequence import with_sequence
from riskflow.operators.wire import stamp_event_time, to_envelope


def replay_selection(
    df: DataFrame, key: Sequence[str], n: int | None = None, label: str = S.LABEL
) -> DataFrame:
    """Every row; ``replay_group`` is 0 for frauds, which go first, and 1 for others.

    With ``n`` only the first so many frauds by ``key`` are taken; rows that tie are
    taken by content.
    """
    fraud = F.coalesce(F.col(label) == 1, F.lit(False))
    if n is None:
        return df.withColumn("replay_group", F.when(fraud, 0).otherwise(1))
    frauds = df.filter(fraud).orderBy(*key, F.xxhash64(*df.columns)).limit(n)
    return frauds.withColumn("replay_group", F.lit(0)).unionByName(
        df.filter(~fraud).withColumn("replay_group", F.lit(1))
    )


def replay_sequence(df: DataFrame, key: Sequence[str], n: int | None = None) -> DataFrame:
    """The selection with its position in the sending order, from 0."""
    return with_sequence(replay_selection(df, key, n), ["replay_group", *key])


def replay_envelopes(
    df: DataFrame,
    key: Sequence[str],
    start_ts: dt.datetime,
    n: int | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Messages of the rows; a row's event time is ``Time`` seconds after ``start_ts``.

    The start is taken as UTC if it has no zone. Messages carry their own event time
    and need no order; ``replay_sequence`` gives one to those who want it.
    """
    if start_ts.tzinfo is None:
        start_ts = start_ts.replace(tzinfo=dt.timezone.utc)
    start_us = round(start_ts.timestamp() * 1_000_000)
    after_us = F.round(F.col("Time") * F.lit(1e6)).cast("long")
    sent = replay_selection(df, key, n).withColumn(
        "_sent_at", F.timestamp_micros(F.lit(start_us) + after_us)
    )
    return to_envelope(stamp_event_time(sent, "_sent_at"), keep=keep)
