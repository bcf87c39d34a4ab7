"""Event time as ISO-8601 UTC text and as a timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_event_time(text: Column | str = "eventTime") -> Column:
    """Timestamp of ISO-8601 text; null, never an error, for anything else."""
    return F.try_to_timestamp(text)


def iso_event_time(ts: Column | str) -> Column:
    """ISO-8601 text with microseconds and a Z; the session must run in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
