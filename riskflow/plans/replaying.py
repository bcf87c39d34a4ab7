"""Turn labelled history into the messages of a replay."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from riskflow.operators.replay import replay_envelopes
from riskflow.sinks.batch import write_envelope_files, write_kafka
from riskflow.sources.history import read_history_csv


def run_replay(
    spark: SparkSession,
    history: str | DataFrame,
    key: Sequence[str],
    start_ts: dt.datetime,
    frauds: int | None = None,
    path: str | None = None,
    servers: str | None = None,
    topic: str | None = None,
) -> None:
    """Write every row of the history as a message, to files (``path``) or to a topic.

    ``frauds`` limits the frauds to the first so many by ``key``.
    """
    if (path is None) == (topic is None):
        raise ValueError("give either a path or a topic")
    if topic is not None and servers is None:
        raise ValueError("a topic needs servers")
    if isinstance(history, str):
        history = read_history_csv(spark, history)
    envelopes = replay_envelopes(history, key, start_ts, frauds)
    if path is not None:
        write_envelope_files(envelopes, path)
    else:
        write_kafka(envelopes, servers, topic)
