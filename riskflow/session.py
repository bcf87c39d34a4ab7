"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings every job depends on. Dates are taken in UTC, and Parquet
# timestamps are written as micros because INT96 columns carry no min/max
# statistics, so a filter on event_ts could never skip a row group.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def build_session(app_name: str, settings: dict[str, str] | None = None) -> SparkSession:
    """A session for the jobs; cluster sizing stays with spark-submit.

    The number of shuffle partitions is left to adaptive execution in batch
    jobs. A streaming aggregate fixes it in its checkpoint at the first start,
    so pass ``spark.sql.shuffle.partitions`` here before that start.
    """
    builder = SparkSession.builder.appName(app_name)
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **RUNTIME_SETTINGS,
        **(settings or {}),
    }.items():
        builder = builder.config(key, value)
    return pin_settings(builder.getOrCreate())


def pin_settings(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else built."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def use_rocksdb_state(spark: SparkSession) -> SparkSession:
    """Keep window state off the JVM heap; set before a query's first start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new, uniquely named folder below the cluster's shared checkpoint folder.

    A machine-local folder is used only by a local master with nothing set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    root = root or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="riskflow-")
    return f"{root.rstrip('/')}/riskflow/{purpose}-{uuid.uuid4().hex}"
