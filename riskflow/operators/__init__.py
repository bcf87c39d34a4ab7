"""DataFrame operators; they take batch and streaming input alike."""

from riskflow.operators.aggregate import (
    daily_aggregates,
    preview,
    window_aggregates,
    window_anomalies,
    with_anomaly_flag,
)
from riskflow.operators.balance import class_balance, class_weights, with_class_weight
from riskflow.operators.overview import overview, overview_of_days
from riskflow.operators.partials import daily_from_partials, daily_partials, merge_partials
from riskflow.operators.replay import replay_envelopes, replay_selection, replay_sequence
from riskflow.operators.sample import stratified_sample
from riskflow.operators.scored import (
    alert_cells,
    alerts,
    scored_columns,
    with_alert_key,
    with_risk_action,
)
from riskflow.operators.sequence import with_sequence
from riskflow.operators.split import hash_split, in_train
from riskflow.operators.wire import (
    drop_missing_event_ts,
    is_rejected,
    label_faults,
    parse_wire,
    split_valid,
    stamp_event_time,
    to_envelope,
    with_event_ts,
)

__all__ = [
    "alert_cells",
    "alerts",
    "class_balance",
    "class_weights",
    "daily_aggregates",
    "daily_from_partials",
    "daily_partials",
    "drop_missing_event_ts",
    "hash_split",
    "in_train",
    "is_rejected",
    "label_faults",
    "merge_partials",
    "overview",
    "overview_of_days",
    "parse_wire",
    "preview",
    "replay_envelopes",
    "replay_selection",
    "replay_sequence",
    "scored_columns",
    "split_valid",
    "stamp_event_time",
    "stratified_sample",
    "to_envelope",
    "window_aggregates",
    "window_anomalies",
    "with_alert_key",
    "with_anomaly_flag",
    "with_class_weight",
    "with_event_ts",
    "with_risk_action",
    "with_sequence",
]
