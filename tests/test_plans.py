"""What the optimizer must be able to do with our expressions."""

import datetime as dt
import re
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helpers import formatted_plan, physical_plan, wire_rows
from riskflow import fixtures, ml
from riskflow import schema as S
from riskflow.operators import (
    alerts,
    daily_aggregates,
    overview_of_days,
    parse_wire,
    preview,
    replay_selection,
    split_valid,
    to_envelope,
    window_aggregates,
    with_class_weight,
    with_event_ts,
    with_risk_action,
    with_sequence,
)
from riskflow.operators.wire import CORRUPT
from riskflow.plans import setup_catalog
from riskflow.sinks import write_daily, write_scored
from riskflow.sources import read_daily, read_scored, read_scored_days
from riskflow.storage import files_below
from riskflow.streaming.fanout import decode_messages

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scored_path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("scored") / "tx")
    write_scored(fixtures.tx(spark, SMALL), path)
    return path


def _read_columns(plan):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>\n", plan)
    return [set(re.findall(r"(\w+):", schema)) for schema in schemas]


def test_daily_reads_three_columns_and_pushes_its_filter(spark, scored_path):
    plan = formatted_plan(daily_aggregates(read_scored(spark, scored_path)))
    assert _read_columns(plan) == [{"Amount", "Class", "event_ts"}]
    assert "IsNotNull(event_ts)" in plan


def test_daily_aggregates_before_its_only_shuffle(spark, scored_path):
    plan = physical_plan(daily_aggregates(read_scored(spark, scored_path)))
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_count" in plan
    assert "Sort" not in plan and "BatchEvalPython" not in plan


def test_day_bound_reaches_the_scan_and_its_statistics(spark, scored_path):
    since = F.lit(dt.date(2024, 1, 20)).cast("timestamp")
    plan = formatted_plan(read_scored(spark, scored_path).filter(F.col("event_ts") >= since))
    assert "GreaterThanOrEqual(event_ts,2024-01-20" in plan
    file = next(p for p in read_scored(spark, scored_path).inputFiles())
    metadata = pq.ParquetFile(file.removeprefix("file://").replace("%20", " ")).metadata
    columns = {metadata.schema.column(i).name: i for i in range(metadata.num_columns)}
    assert metadata.row_group(0).column(columns["event_ts"]).statistics.has_min_max


def test_tier_filter_prunes_folders(spark, scored_path):
    plan = formatted_plan(read_scored(spark, scored_path).filter("Risk_Action = 'BLOCK_CARD'"))
    assert re.search(r"PartitionFilters: \[.*BLOCK_CARD", plan)


def test_panes_are_aggregated_before_any_row_is_copied(spark, scored_path):
    plan = physical_plan(window_aggregates(read_scored(spark, scored_path)))
    scan, expand = plan.index("FileScan"), plan.index("Expand")
    # Printed top down: the copying step sits above two aggregations of panes.
    assert expand < plan.index("partial_sum(Amount") < scan


def test_windows_need_neither_model_nor_score(spark, scored_path):
    history = fixtures.tx(spark, SMALL)
    model = ml.train_model(with_class_weight(history), trees=2, depth=2)
    unscored = read_scored(spark, scored_path).drop("Fraud_Probability")
    scored = with_risk_action(ml.score(model, unscored))
    plan = formatted_plan(window_aggregates(scored))
    assert "UDF" not in plan
    assert _read_columns(plan) == [{"Amount", "Class", "event_ts"}]


def test_scoring_needs_no_python_worker(spark, scored_path):
    history = fixtures.tx(spark, SMALL)
    model = ml.train_model(with_class_weight(history), trees=2, depth=2)
    plan = physical_plan(with_risk_action(ml.score(model, history)))
    assert "Python" not in plan


def test_each_message_is_parsed_once(spark):
    messages = to_envelope(wire_rows(spark, 3))
    valid, rejected = split_valid(with_event_ts(parse_wire(messages, corrupt=CORRUPT)))
    for part in (valid, rejected):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1
    valid, _ = decode_messages(messages)
    assert valid._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_view_prunes_and_broadcasts(spark, scored_path, name, folder):
    write_daily(daily_aggregates(read_scored(spark, scored_path)), folder("daily"))
    names = f"{name}_tx", f"{name}_day", f"{name}_view"
    setup_catalog(spark, scored_path, folder("daily"), *names)
    view = spark.table(names[2]).filter("Risk_Action = 'BLOCK_CARD'")
    plan = formatted_plan(view)
    assert "BroadcastHashJoin" in plan
    assert re.search(r"PartitionFilters: \[.*BLOCK_CARD", plan)
    # The daily side is read only for dates that the other side holds.
    assert "dynamicpruning" in formatted_plan(view.filter("Amount > 300"))


def test_top_k_instead_of_a_global_sort(spark, scored_path):
    tx = read_scored(spark, scored_path)
    first_days = preview(daily_aggregates(tx), "transaction_date")
    assert "TakeOrderedAndProject" in physical_plan(first_days)
    assert "TakeOrderedAndProject" in physical_plan(replay_selection(tx, ["Time"], 10))


def test_whole_view_moves_no_transactions(spark, scored_path, name, folder):
    write_daily(daily_aggregates(read_scored(spark, scored_path)), folder("daily"))
    names = f"{name}_tx", f"{name}_day", f"{name}_view"
    setup_catalog(spark, scored_path, folder("daily"), *names)
    plan = physical_plan(spark.table(names[2]))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_alert_followers_read_only_what_an_alert_holds(spark, scored_path):
    found = alerts(read_scored(spark, scored_path))
    plan = formatted_plan(found)
    assert _read_columns(plan) == [{"eventTime", "Amount", "Fraud_Probability"}]
    assert re.search(r"PartitionFilters: \[.*Risk_Action", plan)


def test_sequence_offsets_are_the_only_broadcast(spark):
    plan = physical_plan(with_sequence(spark.range(1000), ["id"]))
    assert plan.count("BroadcastHashJoin") == 1 and "CartesianProduct" not in plan


def test_days_chosen_by_their_totals_prune_the_transactions(spark, folder):
    """The days that pass the filter reach the scan while the query runs."""
    tx = with_event_ts(
        wire_rows(spark, 40, eventTime=lambda i: f"2025-01-{1 + i % 8:02d}T00:00:00Z")
    ).withColumn("Fraud_Probability", F.lit(0.1))
    write_scored(with_risk_action(tx), folder("scored"), by_day=True)
    write_daily(daily_aggregates(read_scored(spark, folder("scored"))), folder("daily"))
    bad = read_daily(spark, folder("daily")).filter(F.col("max_amount") > 38)
    joined = overview_of_days(read_scored_days(spark, folder("scored")), bad)
    assert "dynamicpruning" in physical_plan(joined)
    for file in files_below(spark, folder("scored")):
        if f"{S.DAY}=2025-01-08" not in file:
            path = Path(folder("scored"), file)
            path.write_bytes(b"never opened")
            path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    rows = joined.collect()
    assert len(rows) == 5 and {r["total_transactions"] for r in rows} == {5}
