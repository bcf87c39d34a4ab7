"""From a streaming sink to a table folder, so that the sink's commit log can forget.

A sink's log names every file it ever wrote, unless a retention is set. What is older
than that must be elsewhere by then: ``publish_scored`` and ``publish_windows`` move new
rows into a table folder, and the ``read_`` functions read both sides as one, each row
once, whichever files the log still names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskflow import schema as S
from riskflow.sinks.batch import write_scored
from riskflow.sources.catalog import is_streaming_sink
from riskflow.sources.scored import read_sink_stream, scored_rows
from riskflow.storage import (
    child_names,
    files_below,
    highest_number,
    move_file,
    path_exists,
    remove_folder,
)
from riskflow.streaming.logs import logged_files, place, planned
from riskflow.streaming.sinks import RUN_TO_COMPLETION

#: Of a published file: the batch that moved it.
_BATCH = r"^batch-(\d+)-"


def _publish(
    rows: DataFrame, write: Callable[[DataFrame, str], None], table: str, checkpoint: str
) -> StreamingQuery:
    spark = rows.sparkSession

    def add(batch: DataFrame, batch_id: int) -> None:
        staging = f"{checkpoint}-staging"
        write(batch, staging)
        counts: dict[str, int] = {}

        def target(folder: str) -> str:
            name = f"batch-{batch_id:06d}-{counts[folder]:05d}.parquet"
            return "/".join(filter(None, (table, folder, name)))

        for file in sorted(files_below(spark, staging)):
            folder = file.rpartition("/")[0]
            counts.setdefault(folder, 0)
            move_file(spark, f"{staging}/{file}", target(folder))
            counts[folder] += 1
        # A try that failed may have made more files of the same rows, numbered onwards.
        for folder in counts:
            while path_exists(spark, target(folder)):
                remove_folder(spark, target(folder))
                counts[folder] += 1
        remove_folder(spark, staging)

    return (
        rows.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(**RUN_TO_COMPLETION)
        .start()
    )


def publish_scored(
    spark: SparkSession, sink: str, table: str, checkpoint: str, by_day: bool = False
) -> StreamingQuery:
    """Add to a table folder what the scored sink has committed since the last time.

    The sink's commit log is followed as a stream, so no row is moved twice. A run
    gathers the new rows into few files per folder, beside the checkpoint (which must
    be on the table's file system), and moves them under names made of the batch and
    the file's number: a run that failed on the way and is repeated replaces all that
    it had moved. Only the new files are touched.
    """
    write = partial(write_scored, by_day=by_day, compact=True)
    return _publish(read_sink_stream(spark, sink), write, table, checkpoint)


def publish_windows(
    spark: SparkSession, sink: str, table: str, checkpoint: str
) -> StreamingQuery:
    """The same for a sink of windows, or of any other rows without folders."""
    rows = spark.readStream.schema(spark.read.parquet(sink).schema).parquet(sink)

    def write(batch: DataFrame, path: str) -> None:
        batch.hint("rebalance").write.mode("overwrite").parquet(path)

    return _publish(rows, write, table, checkpoint)


def published_upto(spark: SparkSession, checkpoint: str) -> int:
    """The last batch that has been published as a whole; -1 before the first."""
    last = highest_number(spark, f"{checkpoint}/commits", r"(\d+)")
    return -1 if last is None else last


def published_files(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(path) of the sink's files whose rows are in the table."""
    upto = published_upto(spark, checkpoint)
    if upto < 0:
        return spark.createDataFrame([], "path string")
    _, last = planned(spark, checkpoint, upto)
    files = logged_files(spark, checkpoint).filter(F.col("batchId") <= last)
    return files.select("path").distinct()


def unpublished_files(spark: SparkSession, sink: str, checkpoint: str) -> list[str]:
    """The files that the sink's log names and the table does not have the rows of.

    They are at most those of the retention; the names of published ones are only joined.
    """
    if not is_streaming_sink(spark, sink):
        return []
    named = spark.read.parquet(sink).inputFiles()
    files = spark.createDataFrame([(name,) for name in named], "path string")
    key = place(F.col("path"), encoded=True).alias("place")
    known = published_files(spark, checkpoint).select(key)
    left = files.select("path", key).join(known, "place", "left_anti")
    return sorted(row["path"] for row in left.collect())


def _whole_batches(rows: DataFrame, upto: int) -> DataFrame:
    """Without files of a batch that is being moved, whose rows the sink still counts."""
    batch = F.regexp_extract(F.col("_metadata.file_name"), _BATCH, 1).try_cast("long")
    return rows.filter(F.coalesce(batch, F.lit(-1)) <= upto)


def read_scored_of_both(
    spark: SparkSession, sink: str, table: str, checkpoint: str
) -> DataFrame:
    """All scored transactions: those published, and those that only the sink has yet."""
    upto = published_upto(spark, checkpoint)
    new = unpublished_files(spark, sink, checkpoint)
    found = []
    if child_names(spark, table):
        stored = spark.read.schema(S.SCORED).parquet(table)
        found.append(_whole_batches(stored, upto).select(*S.SCORED.names))
    if new:
        found.append(scored_rows(spark, sink, files=new))
    if not found:
        return spark.createDataFrame([], S.SCORED)
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def read_windows_of_both(
    spark: SparkSession, sink: str, table: str, checkpoint: str
) -> DataFrame:
    """The same for a sink of windows."""
    schema: T.StructType = spark.read.parquet(sink).schema
    upto = published_upto(spark, checkpoint)
    new = unpublished_files(spark, sink, checkpoint)
    stored = spark.read.schema(schema).parquet(*new) if new else spark.createDataFrame([], schema)
    if child_names(spark, table):
        older = _whole_batches(spark.read.schema(schema).parquet(table), upto)
        stored = older.select(*schema.names).unionByName(stored)
    return stored


def clean_sink(spark: SparkSession, sink: str, checkpoint: str) -> int:
    """Delete files that are published and that the sink's log has forgotten; their number.

    No reader sees them any more, so collect late rows before. Files of rejected messages
    are nobody else's and stay.
    """
    rejected = f"{S.OUTCOME}={S.IS_REJECTED}/"
    there = [file for file in files_below(spark, sink) if not file.startswith(rejected)]
    # By their names, which are unique, as a folder may be spelled in several ways.
    name = F.element_at(F.split(place(F.col("path"), encoded=True), "/"), -1).alias("name")
    named = spark.createDataFrame([(f,) for f in spark.read.parquet(sink).inputFiles()], "path string")
    found = (
        spark.createDataFrame([(f, f.rpartition("/")[2]) for f in there], "file string, name string")
        .join(published_files(spark, checkpoint).select(name), "name", "left_semi")
        .join(named.select(name), "name", "left_anti")
    )
    gone = [f"{sink}/{row['file']}" for row in found.collect()]
    for file in gone:
        remove_folder(spark, file)
    return len(gone)
