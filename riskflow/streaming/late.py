"""Rows that a window query dropped because they came behind its watermark.

Spark counts them but keeps nothing of them. A query's checkpoint says which files each
micro-batch read and which watermark it dropped late rows by, so they can be found again
exactly, whenever the query ran and however often it was restarted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from riskflow import schema as S
from riskflow.storage import finished, highest_number
from riskflow.streaming.logs import logged_files, place, planned

_BATCH = r"(\d+)"
_COLLECTED = r"upto=(\d+)"
_MULTIPLE = "spark.sql.streaming.statefulOperator.allowMultiple"

LATE_BATCH, LATE_BEFORE = "batch_id", "late_before"


class ForgottenBatchesError(RuntimeError):
    """The checkpoint no longer says what the batches after the last collection read."""


def _planned(spark: SparkSession, checkpoint: str, batch: int) -> tuple[int, int]:
    found = planned(spark, checkpoint, batch)
    if found is None:
        raise ForgottenBatchesError(
            f"{checkpoint} has forgotten batch {batch}; collect more often than every "
            "spark.sql.streaming.minBatchesToRetain batches"
        )
    return found


def late_bounds(spark: SparkSession, checkpoint: str, after: int, upto: int) -> DataFrame:
    """(file, batch_id, late_before) of all files that the batches after ``after`` read.

    A window that ends at ``late_before`` or earlier is closed for the rows of the file.
    """
    # With several stateful operators allowed, which is the default, a batch drops late
    # rows by the watermark of the batch before it.
    behind = 1 if spark.conf.get(_MULTIPLE, "true") == "true" else 0
    known = {n: _planned(spark, checkpoint, n) for n in range(max(after, 0), upto + 1)}
    rows = []
    for batch in range(after + 1, upto + 1):
        first = known[batch - 1][1] if batch - 1 in known else -1
        last = known[batch][1]
        if last > first:
            rows.append((first + 1, last, batch, known.get(batch - behind, (0, 0))[0]))
    batches = spark.createDataFrame(
        rows, f"first_log long, last_log long, {LATE_BATCH} long, bound_ms long"
    ).select(
        F.explode(F.sequence("first_log", "last_log")).alias("batchId"),
        LATE_BATCH,
        F.timestamp_millis("bound_ms").alias(LATE_BEFORE),
    )
    files = logged_files(spark, checkpoint).join(batches, "batchId")
    return files.select(F.col("path").alias("file"), LATE_BATCH, LATE_BEFORE)


def collect_late(
    spark: SparkSession,
    checkpoint: str,
    read: Callable[[list[str]], DataFrame],
    path: str,
    length: str = S.WINDOW_LENGTH,
    slide: str = S.WINDOW_SLIDE,
) -> int | None:
    """Store what the watermark dropped since the last collection; the last batch looked at.

    ``read`` gives the rows of some files as the query saw them, with ``event_ts`` and a
    column ``file`` (``_metadata.file_path``). Each dropped row is stored once for every
    window it is missing from, in ``window``. Only files of committed batches that have
    not been collected are opened, and of those no row groups after the last bound. A
    collection writes one folder and starts behind the last whole one, so one that was
    broken off is made again.
    """
    upto = highest_number(spark, f"{checkpoint}/commits", _BATCH)
    after = max(finished(spark, path, _COLLECTED), default=None)
    if upto is None or (after is not None and after >= upto):
        return after
    bounds = late_bounds(spark, checkpoint, -1 if after is None else after, upto)
    bounded = bounds.filter(F.unix_millis(LATE_BEFORE) > 0)
    found = bounded.agg(F.collect_set("file"), F.max(LATE_BEFORE)).first()
    folder = f"{path}/upto={upto}"
    if found[0]:
        early = read(found[0]).filter(F.col("event_ts") < F.lit(found[1]))
        early = early.withColumn("file", place(F.col("file"), encoded=False))
        bounded = bounded.withColumn("file", place(F.col("file"), encoded=True))
        placed = early.join(bounded, "file").withColumn("window", F.window("event_ts", length, slide))
        late = placed.filter(F.col("window.end") <= F.col(LATE_BEFORE)).drop("file")
    else:
        late = read([]).drop("file").limit(0).withColumns(
            {
                LATE_BATCH: F.lit(None).cast("long"),
                LATE_BEFORE: F.lit(None).cast("timestamp"),
                "window": F.lit(None).cast("struct<start:timestamp,end:timestamp>"),
            }
        )
    late.write.mode("overwrite").parquet(folder)
    return upto


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """All that has been collected, with the batch and the bound that dropped it."""
    folders = [f"{path}/upto={n}" for n in finished(spark, path, _COLLECTED)]
    return spark.read.option("basePath", path).parquet(*folders).drop("upto")


def stored_files(spark: SparkSession, sink: str) -> Callable[[list[str]], DataFrame]:
    """Reads files of the scoring query's sink as its followers see them."""

    def read(files: list[str]) -> DataFrame:
        if not files:
            return spark.createDataFrame([], S.STORED).withColumn("file", F.lit(""))
        rows = spark.read.schema(S.STORED).option("basePath", sink).parquet(*files)
        scored = rows.filter(F.col(S.OUTCOME) == S.IS_SCORED)
        return scored.withColumn("file", F.col("_metadata.file_path"))

    return read


def windows_dropped(query: StreamingQuery) -> int:
    """Windows that rows of this run of a query were too late for, once per micro-batch."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )


class WatermarkDrops(StreamingQueryListener):
    """Keeps count of what watermarks drop, by query id, while queries run.

    Spark counts a window once per micro-batch, however many late rows it had. Add one
    with ``spark.streams.addListener``.
    """

    def __init__(self) -> None:
        self.windows: dict[str, int] = {}

    def onQueryProgress(self, event) -> None:  # noqa: N802 (the name Spark calls)
        progress = event.progress
        dropped = sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators)
        key = str(progress.id)
        self.windows[key] = self.windows.get(key, 0) + dropped

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
