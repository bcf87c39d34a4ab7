"""Column functions."""

from riskflow.functions.event_time import iso_event_time, parse_event_time
from riskflow.functions.keys import alert_key, has_position, message_id, split_hash, split_position
from riskflow.functions.rules import (
    fraud_probability,
    is_anomaly,
    is_high_risk,
    risk_action,
)

__all__ = [
    "alert_key",
    "fraud_probability",
    "has_position",
    "is_anomaly",
    "is_high_risk",
    "iso_event_time",
    "message_id",
    "parse_event_time",
    "risk_action",
    "split_hash",
    "split_position",
]
