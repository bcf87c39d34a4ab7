"""Column names, schemas and thresholds shared by every operator and job."""

from __future__ import annotations

from pyspark.sql import types as T

# The wire format, the model contract, the tiers and the table
# layout that existing producers, models and downstream queries rely on.
V_COLUMNS = [f"V{i}" for i in range(1, 29)]
FEATURES = [*V_COLUMNS, "Amount"]
LABEL = "Class"

BLOCK_CARD = "BLOCK_CARD"
TRIGGER_OTP = "TRIGGER_OTP"
ALLOW = "ALLOW"
BLOCK_THRESHOLD = 0.7
OTP_THRESHOLD = 0.4

WINDOW_LENGTH = "10 minutes"
WINDOW_SLIDE = "5 minutes"
WATERMARK = "10 minutes"
MAX_WINDOW_TXN = 1000
MAX_WINDOW_AVG = 500

TRIGGER_INTERVAL = "10 seconds"

SCORED_TABLE = "transactions_stream"
DAILY_TABLE = "daily_fraud_aggregates"
OVERVIEW_VIEW = "fraud_overview"
ALERT_TABLE = "fraud_alerts"
ALERT_FAMILY = "cf"


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_V_FIELDS = [(name, T.DoubleType()) for name in V_COLUMNS]

WIRE = _struct(
    ("Time", T.DoubleType()),
    ("Amount", T.DoubleType()),
    ("Class", T.IntegerType()),
    ("eventTime", T.StringType()),
    *_V_FIELDS,
)

TRAIN = _struct(
    ("Time", T.DoubleType()),
    *_V_FIELDS,
    ("Amount", T.DoubleType()),
    ("Class", T.IntegerType()),
)

SCORED = _struct(
    ("Time", T.DoubleType()),
    ("Amount", T.DoubleType()),
    ("Class", T.IntegerType()),
    ("eventTime", T.StringType()),
    ("event_ts", T.TimestampType()),
    *_V_FIELDS,
    ("Fraud_Probability", T.DoubleType()),
    ("Risk_Action", T.StringType()),
)

DAILY = _struct(
    ("total_transactions", T.LongType()),
    ("total_fraud_transactions", T.LongType()),
    ("avg_amount", T.DoubleType()),
    ("max_amount", T.DoubleType()),
    ("min_amount", T.DoubleType()),
    ("total_blocked", T.LongType()),
    ("total_trigger_otp", T.LongType()),
    ("transaction_date", T.DateType()),
)

ALERT_COLUMNS = ["eventTime", "Amount", "Fraud_Probability", "Risk_Action"]
# End of fixed values.

# What the scoring query stores: every message, scored or rejected, in a folder per
# outcome and tier. A rejected one keeps its text; its tier is NO_TIER. The folders'
# columns come last, as a stream of the files takes them by position.
OUTCOME = "outcome"
IS_SCORED = "scored"
IS_REJECTED = "rejected"
NO_TIER = "NONE"
STORED = T.StructType(
    [
        *_struct(
            ("message_id", T.StringType()),
            ("payload", T.StringType()),
            ("reject_reason", T.StringType()),
        ).fields,
        *SCORED.fields[:-1],
        T.StructField(OUTCOME, T.StringType()),
        SCORED.fields[-1],
    ]
)

# An optional folder below the tier of a table of scored rows: the UTC day.
DAY = "event_date"
