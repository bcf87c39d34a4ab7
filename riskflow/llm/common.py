"""What several operators share: safe column names, scratch tables, a row key."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.session import scratch_dir
from riskflow.storage import remove_folder

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Stands for a null id inside tasks; sorts before every real id.
NULL_ID = -(2**63)


def text_of(docs: DataFrame, text: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one made from it that the columns do not have."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def workers_can_import(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))
    return spark


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again.

    Later steps then start from files that outlive any executor, and do not
    repeat the work before them.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(table: DataFrame) -> None:
    """Deletes the folder of a ``stored`` table that nothing reads any more."""
    folders = {name.rpartition("/")[0] for name in table.inputFiles()}
    for folder in folders:
        remove_folder(table.sparkSession, folder)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
