"""What a checkpoint says of the files that its query has read."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.storage import read_small

#: Of a file source's log: a file in each line but the first.
_LINE = "path string, batchId long"


def planned(spark: SparkSession, checkpoint: str, batch: int) -> tuple[int, int] | None:
    """A batch's watermark in milliseconds, and the last number of the source's log it read.

    None if the checkpoint has forgotten the batch.
    """
    text = read_small(spark, f"{checkpoint}/offsets/{batch}")
    if text is None:
        return None
    _, metadata, *sources = text.splitlines()
    if len(sources) != 1 or not sources[0].startswith("{"):
        raise ValueError(f"{checkpoint} is not of a query over one file source")
    return json.loads(metadata)["batchWatermarkMs"], json.loads(sources[0])["logOffset"]


def logged_files(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(path, batchId) of every file the source has seen; batchId numbers the source's log."""
    # A compacted log repeats the lines of the logs before it.
    lines = spark.read.text(f"{checkpoint}/sources/0").filter("value LIKE '{%'")
    return lines.select(F.from_json("value", _LINE).alias("line")).select("line.*").distinct()


def place(path: Column, encoded: bool) -> Column:
    """One spelling of a file's path: logs encode it as a URI, rows' metadata do not."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))) if encoded else path
    return F.regexp_replace(plain, "^([^:/]+):/+", "$1:/")
