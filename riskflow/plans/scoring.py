"""Score a message stream with a stored model."""

from __future__ import annotations

from functools import partial

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from riskflow.functions import has_position
from riskflow.ml import load_model, score
from riskflow.streaming.fanout import (
    AlertStore,
    StreamPaths,
    await_each,
    start_all,
    start_followers,
    start_scoring,
)


def run_stream(
    spark: SparkSession,
    messages: DataFrame,
    model: str | PipelineModel,
    paths: StreamPaths,
    trigger: dict | None = None,
    follow: bool = True,
    alert_store: AlertStore | None = None,
    max_bytes: int | None = None,
    retention: str | None = None,
    **window_options,
) -> dict[str, StreamingQuery]:
    """Start every output of the scoring job and return the running queries.

    One query reads, parses, scores and stores every message; rejects, alerts and
    windows follow what it stores. Without ``follow`` each output is an independent
    query over the messages, which each does that work again. Alerts go to Parquet
    unless there is an ``alert_store``. ``max_bytes`` bounds a follower's micro-batch.
    With a ``retention``, such as ``"14d"``, the commit log of the scored sink forgets
    older files: publish them in time, and read both sides (see ``streaming.handover``).
    """
    if alert_store is not None and not has_position(messages.columns):
        raise ValueError(
            "a keyed alert store needs messages with a position, such as numbered files: "
            "equal messages would share a key, and one alert would replace the other"
        )
    if isinstance(model, str):
        model = load_model(model)
    scorer = partial(score, model)
    if not follow:
        return start_all(messages, scorer, paths, trigger, alert_store, **window_options)
    started = start_scoring(messages, scorer, paths, trigger, retention)
    if trigger and trigger.get("availableNow"):
        await_each(started.values())
    return started | start_followers(
        spark, paths, trigger, alert_store, max_bytes, **window_options
    )
