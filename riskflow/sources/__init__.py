"""Sources: CSV history, message streams, stored transactions, catalog tables."""

from riskflow.sources.catalog import (
    change_partitions,
    create_overview,
    drop_table,
    is_streaming_sink,
    partition_counts,
    register_partitioned,
    register_sink,
    repair_partitions,
)
from riskflow.sources.envelopes import (
    kafka_options,
    read_envelope_batch,
    read_envelope_files,
    read_kafka,
)
from riskflow.sources.history import read_history_csv
from riskflow.sources.scored import (
    read_daily,
    read_scored,
    read_scored_days,
    read_sink_stream,
    read_stored_stream,
    read_table,
)

__all__ = [
    "change_partitions",
    "create_overview",
    "drop_table",
    "is_streaming_sink",
    "kafka_options",
    "partition_counts",
    "read_daily",
    "read_envelope_batch",
    "read_envelope_files",
    "read_history_csv",
    "read_kafka",
    "read_scored",
    "read_scored_days",
    "read_sink_stream",
    "read_stored_stream",
    "read_table",
    "register_partitioned",
    "register_sink",
    "repair_partitions",
]
