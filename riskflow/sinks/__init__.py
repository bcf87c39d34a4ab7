"""Batch sinks, and a store for alerts in HBase."""

from riskflow.sinks.batch import (
    copy_scored,
    kafka_sink_options,
    write_daily,
    write_envelope_files,
    write_kafka,
    write_scored,
)
from riskflow.sinks.wide_column import hbase_store

__all__ = [
    "copy_scored",
    "hbase_store",
    "kafka_sink_options",
    "write_daily",
    "write_envelope_files",
    "write_kafka",
    "write_scored",
]
