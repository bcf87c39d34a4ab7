"""Deterministic keys: the same row gets the same key on every attempt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

POSITIONS = (("topic", "partition", "offset"), ("file", "line"))

_WORD = 2**32
_MULTIPLIER = 2654435761  # Knuth's 32-bit multiplicative hash


def message_id(columns: Sequence[str], payload: str = "value") -> Column:
    """Identity of a message: its position in the topic, or its place in a file.

    Two equal messages differ in it. Messages that come without either are
    identified by a digest of the whole payload, which equal ones share.
    """
    for position in POSITIONS:
        if set(position) <= set(columns):
            return F.concat_ws("-", *[F.col(name).cast("string") for name in position])
    return F.sha2(F.col(payload).cast("string"), 256)


def has_position(columns: Sequence[str]) -> bool:
    """Whether equal messages differ in their identity."""
    return any(set(position) <= set(columns) for position in POSITIONS)


def alert_key(id_columns: Sequence[str], event_time: Column | str = "eventTime") -> Column:
    """Event time, then the identifying columns, joined by underscores."""
    event_time = F.col(event_time) if isinstance(event_time, str) else event_time
    return F.concat_ws(
        "_",
        F.coalesce(event_time, F.lit("unknown")),
        *[F.col(name).cast("string") for name in id_columns],
    )


def split_hash(key: Column | str) -> Column:
    """32 bits that depend on the integer key alone; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(key, F.lit(2**31)) * F.lit(_MULTIPLIER) % F.lit(_WORD)


def split_position(key: Column | str) -> Column:
    """Position in [0, 1) that depends on the integer key alone."""
    return split_hash(key) / F.lit(float(_WORD))
