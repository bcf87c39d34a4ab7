"""JSON messages to typed rows and back, with a quarantine for bad input."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow import schema as S
from riskflow.functions import iso_event_time, parse_event_time

CORRUPT = "_corrupt_record"
REASON = "reject_reason"

BAD_JSON = "bad_json"
BAD_FEATURE = "bad_feature"
BAD_EVENT_TIME = "bad_event_time"


def parse_wire(
    messages: DataFrame,
    schema: T.StructType = S.WIRE,
    payload: str = "value",
    keep: Sequence[str] = (),
    corrupt: str | None = None,
) -> DataFrame:
    """Decode one JSON object per message (text or binary) into columns.

    Parsing is permissive: a field that does not fit its type is null. With
    ``corrupt`` that column also holds the text of every message that did not
    parse cleanly. ``keep`` names input columns to carry along.

    The struct is expanded by a generator, not by ``data.*``: Catalyst copies
    ``from_json`` into a filter above a projection once for each field the
    filter reads, while it never moves a filter below a generator.
    """
    options = {"mode": "PERMISSIVE"}
    if corrupt is not None:
        schema = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
        options["columnNameOfCorruptRecord"] = corrupt
    decoded = F.from_json(F.col(payload).cast("string"), schema, options)
    return messages.select(*keep, F.inline(F.array(decoded)))


def with_event_ts(df: DataFrame, src: str = "eventTime") -> DataFrame:
    return df.withColumn("event_ts", parse_event_time(src))


def drop_missing_event_ts(df: DataFrame) -> DataFrame:
    return df.filter(F.col("event_ts").isNotNull())


def _not_scorable() -> Column:
    """Some feature is null or NaN."""
    return reduce(
        lambda left, right: left | right,
        [F.col(name).isNull() | F.isnan(name) for name in S.FEATURES],
    )


def label_faults(df: DataFrame, payload: str | None = None) -> DataFrame:
    """Add ``reject_reason``, the first thing wrong with a row, or null.

    Needs the columns of :func:`parse_wire` with ``corrupt=CORRUPT`` and
    ``event_ts``. A message that does not parse comes first (an empty or missing
    one too, if ``payload`` names the text), then a feature that is null or NaN,
    then a missing event time. A null label (``Class``) is not an error; scoring
    ignores it.
    """
    corrupt = F.col(CORRUPT).isNotNull()
    if payload is not None:
        corrupt |= F.trim(F.coalesce(F.col(payload).cast("string"), F.lit(""))) == ""
    return df.withColumn(
        REASON,
        F.when(corrupt, BAD_JSON)
        .when(_not_scorable(), BAD_FEATURE)
        .when(F.col("event_ts").isNull(), BAD_EVENT_TIME),
    )


def is_rejected() -> Column:
    """Whether a labelled row cannot be scored. A missing event time alone does not
    reject it: the daily totals leave such rows out themselves."""
    return F.coalesce(F.col(REASON).isin(BAD_JSON, BAD_FEATURE), F.lit(False))


def split_valid(df: DataFrame, payload: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that can be scored, and rejected rows; together they are the input.

    Each part reads the input for itself. Where both are wanted, one pass over
    :func:`label_faults` gives them together.
    """
    labelled = label_faults(df, payload)
    return labelled.filter(~is_rejected()), labelled.filter(is_rejected())


def stamp_event_time(df: DataFrame, ts: str) -> DataFrame:
    """Add ``eventTime``: the timestamp column ``ts`` as ISO-8601 UTC text."""
    return df.withColumn("eventTime", iso_event_time(ts))


def to_envelope(
    df: DataFrame, schema: T.StructType = S.WIRE, keep: Sequence[str] = ()
) -> DataFrame:
    """One JSON object per row in ``value``, each field in its wire type.

    The cast matters for the label: ``1.0`` does not parse as an integer on
    the reading side.
    """
    fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*keep, F.to_json(F.struct(*fields)).alias("value"))
