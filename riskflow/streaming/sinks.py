"""Checkpointed streaming sinks.

Every sink needs its own checkpoint folder. ``trigger`` takes the keyword
arguments of ``DataStreamWriter.trigger``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from riskflow import schema as S
from riskflow.operators.scored import alert_cells, scored_columns
from riskflow.streaming.guards import BATCH_FOLDERS, FILE_SINK_LOG, claim_sink, guard_sink

EVERY_INTERVAL = {"processingTime": S.TRIGGER_INTERVAL}
RUN_TO_COMPLETION = {"availableNow": True}


def _append_files(
    df: DataFrame,
    writer: DataStreamWriter,
    path: str,
    checkpoint: str,
    trigger: dict | None,
    retention: str | None,
) -> StreamingQuery:
    guard_sink(df.sparkSession, path, checkpoint, FILE_SINK_LOG)
    if retention is not None:
        writer = writer.option("retention", retention)
    query = (
        writer.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or EVERY_INTERVAL))
        .start()
    )
    return claim_sink(df.sparkSession, path, query)


def write_parquet_stream(
    df: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    retention: str | None = None,
) -> StreamingQuery:
    """Rows as they are, each written once.

    The sink's commit log names every file for ever and is rewritten now and then. With
    a ``retention``, such as ``"14d"``, files that are older fall out of the log, and
    whoever reads the sink no longer sees them: publish them before (see ``handover``),
    and let every follower be quicker than that.
    """
    return _append_files(df, df.writeStream, path, checkpoint, trigger, retention)


def write_scored_stream(
    scored: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    keep: Sequence[str] = (),
    retention: str | None = None,
) -> StreamingQuery:
    """Scored transactions, one folder per tier; ``keep`` names further columns."""
    rows = scored.select(*scored_columns(), *keep)
    writer = rows.writeStream.partitionBy("Risk_Action")
    return _append_files(rows, writer, path, checkpoint, trigger, retention)


def write_stored_stream(
    stored: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    retention: str | None = None,
) -> StreamingQuery:
    """Every message, scored or rejected, in a folder per outcome and tier."""
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in S.STORED.fields]
    rows = stored.select(*columns)
    writer = rows.writeStream.partitionBy(S.OUTCOME, "Risk_Action")
    return _append_files(rows, writer, path, checkpoint, trigger, retention)


def write_windows_stream(
    windows: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    retention: str | None = None,
) -> StreamingQuery:
    """Closed windows, each written once, when the watermark has passed its end."""
    return write_parquet_stream(windows, path, checkpoint, trigger, retention)


def write_alerts_stream(
    keyed_alerts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Alerts as keyed text cells in Parquet, one folder per micro-batch.

    The executors write the rows. A batch that is replayed after a failure
    replaces its own folder, and the keys are deterministic, so alerts are
    neither lost nor doubled.
    """
    guard_sink(keyed_alerts.sparkSession, path, checkpoint, BATCH_FOLDERS)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = store_alerts(keyed_alerts, store, checkpoint, trigger)
    return claim_sink(keyed_alerts.sparkSession, path, query)


def store_alerts(
    keyed_alerts: DataFrame,
    store: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Hand each micro-batch of alert cells, unless empty, to ``store``.

    ``store`` may see a batch again after a failure and must then leave the
    same result.
    """

    def store_unless_empty(batch: DataFrame, batch_id: int) -> None:
        # The test stops at the first alert, so the batch is not kept for it.
        if not batch.isEmpty():
            store(batch, batch_id)

    return (
        alert_cells(keyed_alerts)
        .writeStream.foreachBatch(store_unless_empty)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or EVERY_INTERVAL))
        .start()
    )
