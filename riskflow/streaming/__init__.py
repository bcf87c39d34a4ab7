"""Streaming sinks, their start guard and the fan-out from one stream."""

from riskflow.streaming.fanout import (
    StreamPaths,
    await_any,
    await_each,
    start_all,
    start_followers,
    start_scoring,
)
from riskflow.streaming.guards import StaleCheckpointError, guard_sink
from riskflow.streaming.handover import (
    clean_sink,
    publish_scored,
    publish_windows,
    read_scored_of_both,
    read_windows_of_both,
    unpublished_files,
)
from riskflow.streaming.late import (
    ForgottenBatchesError,
    WatermarkDrops,
    collect_late,
    read_late,
    stored_files,
    windows_dropped,
)
from riskflow.streaming.sinks import (
    EVERY_INTERVAL,
    RUN_TO_COMPLETION,
    store_alerts,
    write_alerts_stream,
    write_parquet_stream,
    write_scored_stream,
    write_stored_stream,
    write_windows_stream,
)
from riskflow.streaming.state import current_windows, open_windows

__all__ = [
    "EVERY_INTERVAL",
    "RUN_TO_COMPLETION",
    "ForgottenBatchesError",
    "StaleCheckpointError",
    "StreamPaths",
    "WatermarkDrops",
    "await_any",
    "await_each",
    "clean_sink",
    "collect_late",
    "current_windows",
    "guard_sink",
    "open_windows",
    "publish_scored",
    "publish_windows",
    "read_late",
    "read_scored_of_both",
    "read_windows_of_both",
    "start_all",
    "start_followers",
    "start_scoring",
    "store_alerts",
    "stored_files",
    "unpublished_files",
    "windows_dropped",
    "write_alerts_stream",
    "write_parquet_stream",
    "write_scored_stream",
    "write_stored_stream",
    "write_windows_stream",
]
