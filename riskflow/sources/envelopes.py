"""Message streams: a Kafka topic, or files holding the same messages."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pyarrow as pa

#: A file source forgets files older than its limit, and then never reads such a
#: file that arrives late. A century is no limit.
ANY_AGE = "36500d"

#: Hadoop's codec that hands on the bytes as they are. Files of its extension are not split.
#: Spark's own Hadoop client has another name for the second setting.
_EXTENSION = "io.compress.passthrough.extension"
UNSPLIT = {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec"}
UNSPLIT_SUFFIX = (_EXTENSION, f"org.apache.hadoop.shaded.{_EXTENSION}")


def kafka_options(
    servers: str,
    topic: str,
    starting: str = "earliest",
    max_offsets_per_trigger: int | None = None,
    min_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> dict[str, str]:
    """Options of the Kafka source.

    ``max_offsets_per_trigger`` bounds a micro-batch, which matters for the
    first one when a long topic is read from its start. ``min_partitions``
    splits large topic partitions over more tasks. ``extra`` adds options as
    they are, such as those of a secured broker.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
    }
    if max_offsets_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    if min_partitions is not None:
        options["minPartitions"] = str(min_partitions)
    return options | (extra or {})


def read_kafka(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """A topic as a stream; needs the spark-sql-kafka connector on the class path."""
    return (
        spark.readStream.format("kafka").options(**kafka_options(servers, topic, **options)).load()
    )


def read_envelope_files(
    spark: SparkSession,
    path: str,
    max_files_per_trigger: int | None = None,
    max_file_age: str = ANY_AGE,
    numbered: bool = False,
    suffix: str = ".txt",
) -> DataFrame:
    """Text files with one message per line, as a stream with a ``value`` column.

    With ``numbered`` a message also has its place, ``file`` and ``line``, which tells
    equal messages apart and is the same whenever the file is read. One task then
    reads all of a file, line by line, so its memory does not depend on the file's size;
    many files are read side by side. That holds for names that end in ``suffix``, a dot
    and an extension, and for gzip files. Spark may split others that are large, and
    there the query fails: the number of lines before a piece is not known.

    By default a file is read however old it is. A shorter ``max_file_age`` leaves
    out files that are older than that, counted back from the newest one seen,
    and in turn lets Spark forget the names of older files.
    """
    reader = spark.readStream.schema("value string").option("maxFileAge", max_file_age)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if not numbered:
        return reader.text(path)
    lines = reader.options(**UNSPLIT, **dict.fromkeys(UNSPLIT_SUFFIX, suffix)).text(path)
    split = F.concat(
        F.lit("cannot number the lines of a file that was split, give its suffix: "),
        "_metadata.file_path",
    )
    file = F.when(F.col("_metadata.file_block_start") == 0, F.col("_metadata.file_path"))
    return lines.select(
        file.otherwise(F.raise_error(split).cast("string")).alias("file"), "value"
    ).mapInArrow(_number_lines, "file string, line int, value string")


def _number_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``line``, from 0 in each file; a task has the lines of a file in their order."""
    # Only numbered files need these packages.
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    last, after = None, 0
    for batch in batches:
        files = pc.run_end_encode(batch.column("file"))
        lines, begin = [np.empty(0, np.int32)], 0
        for file, end in zip(files.values.to_pylist(), files.run_ends.to_pylist()):
            if file != last:
                last, after = file, 0
            lines.append(np.arange(after, after + end - begin, dtype=np.int32))
            after, begin = after + end - begin, end
        columns = [batch.column("file"), pa.array(np.concatenate(lines)), batch.column("value")]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "line", "value"])


def read_envelope_batch(spark: SparkSession, path: str) -> DataFrame:
    """The same files as a bounded input, for backfills and checks."""
    return spark.read.text(path)
