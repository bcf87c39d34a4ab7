"""From one message stream to scored rows, alerts, windows and rejects."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskflow import schema as S
from riskflow.functions import message_id
from riskflow.operators.aggregate import window_anomalies
from riskflow.operators.scored import alerts, with_alert_key, with_risk_action
from riskflow.operators.wire import (
    CORRUPT,
    REASON,
    is_rejected,
    label_faults,
    parse_wire,
    with_event_ts,
)
from riskflow.sources.scored import read_stored_stream
from riskflow.storage import ensure_folder
from riskflow.streaming.sinks import (
    store_alerts,
    write_alerts_stream,
    write_parquet_stream,
    write_scored_stream,
    write_stored_stream,
    write_windows_stream,
)

Scorer = Callable[[DataFrame], DataFrame]
AlertStore = Callable[[DataFrame, int], None]


@dataclass(frozen=True)
class StreamPaths:
    """Output and checkpoint folders below one root."""

    root: str

    @property
    def scored(self) -> str:
        return f"{self.root}/transactions"

    @property
    def alerts(self) -> str:
        return f"{self.root}/alerts"

    @property
    def windows(self) -> str:
        return f"{self.root}/aggregates"

    @property
    def late(self) -> str:
        return f"{self.root}/late"

    @property
    def rejects(self) -> str:
        return f"{self.root}/rejects"

    def checkpoint(self, sink: str) -> str:
        return f"{self.root}/checkpoints/{sink}"


def label_messages(messages: DataFrame) -> DataFrame:
    """Every message parsed once, with ``message_id``, ``payload`` and ``reject_reason``."""
    identified = messages.select(
        message_id(messages.columns).alias("message_id"),
        F.col("value").cast("string").alias("payload"),
    )
    parsed = parse_wire(
        identified, payload="payload", keep=["message_id", "payload"], corrupt=CORRUPT
    )
    return label_faults(with_event_ts(parsed), "payload").drop(CORRUPT)


def decode_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scorable transactions and rejects, both with ``message_id``."""
    labelled = label_messages(messages)
    return (
        labelled.filter(~is_rejected()).drop("payload"),
        labelled.filter(is_rejected()).select("message_id", "payload", REASON),
    )


def score_labelled(labelled: DataFrame, scorer: Scorer) -> DataFrame:
    """Every labelled message with its outcome; score and tier for those that have one.

    The scorer refuses missing features, so a rejected row is shown to it with zeros.
    Its score is dropped, and only its text and reason are kept.
    """
    bad = F.col("_rejected")
    filled = labelled.withColumn("_rejected", is_rejected()).withColumns(
        {name: F.when(bad, 0.0).otherwise(F.col(name)) for name in S.FEATURES}
    )
    tiered = with_risk_action(scorer(filled))
    cleared = {name: F.when(~bad, F.col(name)) for name in [*S.FEATURES, "Fraud_Probability"]}
    return tiered.withColumns(
        {
            **cleared,
            "payload": F.when(bad, F.col("payload")),
            "Risk_Action": F.when(bad, S.NO_TIER).otherwise(F.col("Risk_Action")),
            S.OUTCOME: F.when(bad, S.IS_REJECTED).otherwise(S.IS_SCORED),
        }
    ).drop("_rejected")


def start_all(
    messages: DataFrame,
    scorer: Scorer,
    paths: StreamPaths,
    trigger: dict | None = None,
    alert_store: AlertStore | None = None,
    **window_options,
) -> dict[str, StreamingQuery]:
    """Start one independent query per output, as a failure then stops only one.

    Each query reads and parses the messages, and both the scored and the
    alert query score them. ``start_scoring`` with ``start_followers`` does
    that work once. The window query needs no score, so its plan has none.
    Alerts go to Parquet, or to ``alert_store`` if there is one.
    """
    valid, rejected = decode_messages(messages)
    scored = with_risk_action(scorer(valid))
    return {
        "scored": write_scored_stream(
            scored, paths.scored, paths.checkpoint("scored"), trigger
        ),
        "rejects": write_parquet_stream(
            rejected, paths.rejects, paths.checkpoint("rejects"), trigger
        ),
    } | _start_alerts_and_windows(scored, valid, paths, trigger, alert_store, **window_options)


def start_scoring(
    messages: DataFrame,
    scorer: Scorer,
    paths: StreamPaths,
    trigger: dict | None = None,
    retention: str | None = None,
) -> dict[str, StreamingQuery]:
    """Start the one query that reads, parses and scores the messages and stores them all."""
    stored = score_labelled(label_messages(messages), scorer)
    checkpoint = paths.checkpoint("scored")
    with pool(messages.sparkSession, "scored"):
        query = write_stored_stream(stored, paths.scored, checkpoint, trigger, retention)
    return {"scored": query}


def start_followers(
    spark: SparkSession,
    paths: StreamPaths,
    trigger: dict | None = None,
    alert_store: AlertStore | None = None,
    max_bytes: int | None = None,
    **window_options,
) -> dict[str, StreamingQuery]:
    """Start rejects, alerts and windows on top of what the scoring query stores.

    They read its commit log as a stream: messages are read, parsed and scored
    once, rejects and alerts open only the folders of their outcome and tiers,
    and windows read three columns. The outputs are those of ``start_all``,
    one trigger later. With a run-to-completion trigger, wait for the scoring
    query first. ``max_bytes`` bounds a micro-batch, so that a backlog
    after an outage comes in several; a file is never split.
    """
    ensure_folder(spark, paths.scored)  # a stream cannot be read from a missing one
    stored = read_stored_stream(spark, paths.scored, max_bytes=max_bytes)
    scored = stored.filter(F.col(S.OUTCOME) == S.IS_SCORED)
    rejected = stored.filter(F.col(S.OUTCOME) == S.IS_REJECTED)
    with pool(spark, "rejects"):
        rejects = write_parquet_stream(
            rejected.select("message_id", "payload", REASON),
            paths.rejects,
            paths.checkpoint("rejects"),
            trigger,
        )
    return {"rejects": rejects} | _start_alerts_and_windows(scored, scored, paths, trigger, alert_store, **window_options)


def _start_alerts_and_windows(
    scored: DataFrame,
    tx: DataFrame,
    paths: StreamPaths,
    trigger: dict | None,
    alert_store: AlertStore | None,
    **window_options,
) -> dict[str, StreamingQuery]:
    keyed = with_alert_key(alerts(scored, keep=["message_id"]), ["message_id"])
    checkpoint = paths.checkpoint("alerts")
    with pool(scored.sparkSession, "alerts"):
        if alert_store is None:
            found = write_alerts_stream(keyed, paths.alerts, checkpoint, trigger)
        else:
            found = store_alerts(keyed, alert_store, checkpoint, trigger)
    with pool(scored.sparkSession, "windows"):
        windows = write_windows_stream(
            window_anomalies(tx, **window_options),
            paths.windows,
            paths.checkpoint("windows"),
            trigger,
        )
    return {"alerts": found, "windows": windows}


@contextmanager
def pool(spark: SparkSession, name: str):
    """Queries started inside run their jobs in a scheduler pool of that name.

    With ``spark.scheduler.mode=FAIR`` the pools share the executors evenly, so a long
    batch of one output does not hold up the others; otherwise the name has no effect.
    """
    context, key = spark.sparkContext, "spark.scheduler.pool"
    before = context.getLocalProperty(key)
    context.setLocalProperty(key, f"riskflow-{name}")
    try:
        yield
    finally:
        context.setLocalProperty(key, before)


def await_each(queries: Iterable[StreamingQuery]) -> None:
    """Wait until every query has ended; raises if one of them failed."""
    for query in queries:
        query.awaitTermination()


def await_any(spark: SparkSession) -> None:
    """Wait until some query ends; raises if that one failed."""
    spark.streams.awaitAnyTermination()
