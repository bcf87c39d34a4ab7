"""Tables and views over stored data.

A folder that a batch job wrote becomes an external partitioned table. A
folder that a streaming sink writes becomes a view that reads it by path, as
only path reads honour the sink's commit log.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskflow import schema as S
from riskflow.operators.overview import DAILY_COLUMNS, TX_COLUMNS
from riskflow.storage import path_exists

SINK_LOG = "_spark_metadata"


def _quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def _is_view(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType == "VIEW"


def is_streaming_sink(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/{SINK_LOG}")


def drop_table(spark: SparkSession, name: str) -> None:
    """Forget a table or view; the data of an external table stays where it is."""
    kind = "VIEW" if _is_view(spark, name) else "TABLE"
    spark.sql(f"DROP {kind} IF EXISTS {_quoted(name)}")


def register_partitioned(
    spark: SparkSession,
    name: str,
    schema: T.StructType,
    partition: str,
    path: str,
    if_not_exists: bool = True,
) -> None:
    """Declare an external Parquet table, partitioned by one column of ``schema``.

    A folder written by a streaming sink is refused: a table there would not
    be partitioned, or would read past the sink's commit log.
    """
    if is_streaming_sink(spark, path):
        raise ValueError(f"{path} is a streaming sink; use register_sink or copy it first")
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    guard = "IF NOT EXISTS " if if_not_exists else ""
    spark.sql(
        f"CREATE TABLE {guard}{_quoted(name)} ({columns}) USING parquet "
        f"PARTITIONED BY ({_quoted(partition)}) LOCATION '{path}'"
    )


def register_sink(spark: SparkSession, name: str, schema: T.StructType, path: str) -> None:
    """Name a streaming sink's committed rows, in the columns of ``schema``.

    Files are listed when the view is read, so new batches and partitions need
    no repair, and filters on the partition column still prune folders.
    """
    columns = ", ".join(_quoted(f.name) for f in schema.fields)
    stored = spark.read.parquet(path).columns
    scored = f" WHERE {S.OUTCOME} = '{S.IS_SCORED}'" if S.OUTCOME in stored else ""
    spark.sql(f"CREATE VIEW {_quoted(name)} AS SELECT {columns} FROM parquet.`{path}`{scored}")


def repair_partitions(spark: SparkSession, name: str) -> None:
    """Bring a table's partitions in line with its folders; a view has none.

    Partitions whose folder is gone are dropped, and files listed before are forgotten.
    """
    if not _is_view(spark, name):
        spark.sql(f"MSCK REPAIR TABLE {_quoted(name)} SYNC PARTITIONS")
        spark.sql(f"REFRESH TABLE {_quoted(name)}")


#: Partitions in one statement: the catalog is asked once for all of them.
_AT_ONCE = 500


def change_partitions(
    spark: SparkSession,
    name: str,
    partition: str,
    path: str,
    present: Iterable[object] = (),
    gone: Iterable[object] = (),
) -> None:
    """Add and drop just the partitions that a write touched.

    The folders are known to whoever wrote them, so nothing is listed, however many
    partitions the table has. A view has no partitions; ``repair_partitions`` remains
    for folders that somebody else changed.
    """
    if _is_view(spark, name):
        return

    def place(value: object) -> str:
        return f"PARTITION ({_quoted(partition)} = '{value}')"

    added = [f"{place(v)} LOCATION '{path}/{partition}={v}'" for v in sorted(set(present))]
    dropped = [place(v) for v in sorted(set(gone))]
    for change, places, between in (("ADD IF NOT EXISTS", added, " "), ("DROP IF EXISTS", dropped, ", ")):
        for at in range(0, len(places), _AT_ONCE):
            some = between.join(places[at : at + _AT_ONCE])
            spark.sql(f"ALTER TABLE {_quoted(name)} {change} {some}")
    # What Spark remembers of the files of a partition that was written again.
    spark.sql(f"REFRESH TABLE {_quoted(name)}")


def partition_counts(spark: SparkSession, name: str, partition: str) -> DataFrame:
    return spark.table(name).groupBy(partition).count().withColumnRenamed("count", "n_rows")


def create_overview(spark: SparkSession, tx: str, daily: str, name: str) -> None:
    """Named view over the two tables, if it does not exist yet.

    The view carries no join hint. Spark broadcasts the daily side while its
    size is below spark.sql.autoBroadcastJoinThreshold, and otherwise joins by
    shuffle, splitting skewed partitions when adaptive execution is on.
    """
    columns = ", ".join(
        [f"t.{_quoted(c)}" for c in TX_COLUMNS] + [f"d.{_quoted(c)}" for c in DAILY_COLUMNS]
    )
    spark.sql(
        f"CREATE VIEW IF NOT EXISTS {_quoted(name)} AS SELECT {columns} "
        f"FROM {_quoted(tx)} t LEFT JOIN {_quoted(daily)} d "
        # Rows without a time can match no day; in a join by shuffle they are dealt out
        # over days that no total has, instead of all meeting in one task.
        f"ON coalesce(to_date(t.event_ts), date_add(DATE'0001-01-01', "
        f"CAST(pmod(xxhash64(t.Time, t.Amount, t.V1), 1000) AS INT))) = d.transaction_date"
    )
