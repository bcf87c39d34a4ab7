"""Consecutive numbers over a total order, without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskflow.session import scratch_dir
from riskflow.storage import remove_folder

_POSITION_BITS = 33  # monotonically_increasing_id: partition above, row position below


def with_sequence(
    df: DataFrame,
    order_by: Sequence[str],
    name: str = "sequence",
    start: int = 0,
    scratch: str | None = None,
    unique: bool = False,
) -> DataFrame:
    """Number the rows ``start, start + 1, …`` in the order of ``order_by``.

    Rows that tie are ordered by their content; copies of a row are
    interchangeable. Rows are stored, range-partitioned, sorted within
    partitions and stored again with their position. Then each partition's
    offset, one small row per partition, is joined back.

    The first store gives every row a fixed place in a file. As the last
    sorting key that place splits a large group of ties or copies over several
    partitions, and a retried task still deals each row out the same way. The
    second fixes the partition borders, which sampling would choose anew on
    every run. The first is removed as soon as the second is there. Say
    ``unique`` if no two rows agree in ``order_by``: then it is not made at all.
    """
    spark = df.sparkSession
    scratch = scratch or scratch_dir(spark, "sequence")
    if unique:
        rows, order = df, [*order_by]
    else:
        df.write.parquet(f"{scratch}/rows")
        rows = spark.read.schema(df.schema).parquet(f"{scratch}/rows")
        rows = rows.withColumns(
            {
                "_content": F.xxhash64(*df.columns),
                "_file": F.col("_metadata.file_name"),
                "_row": F.col("_metadata.row_index"),
            }
        )
        order = [*order_by, "_content", "_file", "_row"]
    (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(*df.columns, F.monotonically_increasing_id().alias("_id"))
        .write.parquet(f"{scratch}/sorted")
    )
    remove_folder(spark, f"{scratch}/rows")
    return _number_stored_rows(spark, f"{scratch}/sorted", name, start)


def _number_stored_rows(spark: SparkSession, path: str, name: str, start: int) -> DataFrame:
    stored = spark.read.parquet(path).withColumn(
        "_part", F.shiftright("_id", _POSITION_BITS).cast("int")
    )
    # One row per written partition, so this unpartitioned window stays small.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    position = F.col("_id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        stored.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + position + F.lit(start))
        .drop("_part", "_id", "_offset")
    )
