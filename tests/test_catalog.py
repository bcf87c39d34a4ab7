import datetime as dt
import re
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import formatted_plan, transactions, wire_rows
from riskflow import schema as S
from riskflow import streaming as st
from riskflow.operators import daily_aggregates, to_envelope, with_event_ts, with_risk_action
from riskflow.plans import run_daily, setup_catalog
from riskflow.sinks import copy_scored, write_daily, write_envelope_files, write_scored
from riskflow.sources import (
    drop_table,
    partition_counts,
    read_daily,
    read_envelope_files,
    read_scored,
    register_partitioned,
    register_sink,
    repair_partitions,
)
from riskflow.storage import files_below
from riskflow.streaming.fanout import decode_messages


def _scored(spark, n=20, day="2025-01-01"):
    rows = wire_rows(spark, n, eventTime=lambda i: f"{day}T00:00:{i % 60:02d}Z")
    return with_risk_action(
        with_event_ts(rows).withColumn("Fraud_Probability", F.col("V1") % 10 / 10)
    )


def test_partitions_appear_after_repair_only(spark, name, folder):
    path = folder("daily")
    write_daily(daily_aggregates(_scored(spark)), path)
    register_partitioned(spark, name, S.DAILY, "transaction_date", path)
    assert spark.table(name).count() == 0
    repair_partitions(spark, name)
    assert spark.table(name).count() == 1
    write_daily(daily_aggregates(_scored(spark, day="2025-01-02")), path, dynamic=True)
    assert spark.table(name).count() == 1
    repair_partitions(spark, name)
    assert partition_counts(spark, name, "transaction_date").count() == 2


def test_repair_drops_partitions_whose_folder_is_gone(spark, name, folder):
    path = folder("daily")
    both = _scored(spark).unionByName(_scored(spark, day="2025-01-02"))
    write_daily(daily_aggregates(both), path)
    register_partitioned(spark, name, S.DAILY, "transaction_date", path)
    repair_partitions(spark, name)
    write_daily(daily_aggregates(_scored(spark, day="2025-01-02")), path)
    repair_partitions(spark, name)
    assert [r[0] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()] == [
        "transaction_date=2025-01-02"
    ]


def test_a_day_opens_its_own_folders_only(spark, folder):
    both = _scored(spark).unionByName(_scored(spark, 7, day="2025-01-02"))
    write_scored(both, folder("scored"), by_day=True)
    recent = read_scored(spark, folder("scored"), dt.date(2025, 1, 2))
    assert recent.count() == 7 and recent.columns == S.SCORED.names
    assert re.search(r"PartitionFilters: \[.*event_date.*2025-01-02", formatted_plan(recent))
    plain = folder("plain")
    write_scored(both, plain)
    assert read_scored(spark, plain, dt.date(2025, 1, 2)).count() == 7


def test_dropping_a_table_keeps_its_data(spark, name, folder):
    write_scored(_scored(spark), folder("scored"))
    register_partitioned(spark, name, S.SCORED, "Risk_Action", folder("scored"))
    drop_table(spark, name)
    drop_table(spark, name)
    assert not spark.catalog.tableExists(name)
    assert spark.read.parquet(folder("scored")).count() == 20


def test_registering_twice_is_fine_unless_asked_otherwise(spark, name, folder):
    write_scored(_scored(spark), folder("scored"))
    register_partitioned(spark, name, S.SCORED, "Risk_Action", folder("scored"))
    register_partitioned(spark, name, S.SCORED, "Risk_Action", folder("scored"))
    with pytest.raises(Exception, match="(?i)already"):
        register_partitioned(
            spark, name, S.SCORED, "Risk_Action", folder("scored"), if_not_exists=False
        )


def test_static_overwrite_drops_other_days_and_dynamic_keeps_them(spark, folder):
    first, second = (daily_aggregates(_scored(spark, day=d)) for d in ("2025-01-01", "2025-01-02"))
    both = first.unionByName(second)
    for dynamic, days in ((False, 1), (True, 2)):
        path = folder(f"daily-{dynamic}")
        write_daily(both, path)
        write_daily(second, path, dynamic=dynamic)
        assert read_daily(spark, path).count() == days


def _stream_more(spark, folder, n=30):
    write_envelope_files(to_envelope(wire_rows(spark, n)), folder("messages"))
    valid, _ = decode_messages(read_envelope_files(spark, folder("messages")))
    scored = with_risk_action(valid.withColumn("Fraud_Probability", F.col("V1") / 30))
    st.write_scored_stream(
        scored, folder("sink"), folder("check"), st.RUN_TO_COMPLETION
    ).awaitTermination()


def test_a_streaming_sink_is_copied_before_it_becomes_a_table(spark, name, folder):
    _stream_more(spark, folder)
    with pytest.raises(ValueError, match="streaming sink"):
        register_partitioned(spark, name, S.SCORED, "Risk_Action", folder("sink"))
    copy_scored(spark, folder("sink"), folder("table"))
    register_partitioned(spark, name, S.SCORED, "Risk_Action", folder("table"))
    repair_partitions(spark, name)
    assert spark.table(name).count() == 30


@pytest.mark.parametrize("by_day", [False, True])
def test_publishing_again_moves_only_what_is_new(spark, name, folder, by_day):
    def publish():
        st.publish_scored(
            spark, folder("sink"), folder("table"), folder("published"), by_day
        ).awaitTermination()
        return set(files_below(spark, folder("table")))

    _stream_more(spark, folder)
    first = publish()
    assert publish() == first
    _stream_more(spark, folder, 12)
    times = {f: Path(folder("table"), f).stat().st_mtime_ns for f in first}
    second = publish()
    assert first < second and all(f.rpartition("/")[2].startswith("batch-000001") for f in second - first)
    assert times == {f: Path(folder("table"), f).stat().st_mtime_ns for f in first}
    assert read_scored(spark, folder("table")).count() == 42

    # A run that moved its files and then failed to say so is repeated.
    for file in ("1", ".1.crc"):
        Path(folder("published"), "commits", file).unlink()
    assert publish() == second
    assert read_scored(spark, folder("table")).count() == 42
    if not by_day:
        register_partitioned(spark, name, S.SCORED, "Risk_Action", folder("table"))
        repair_partitions(spark, name)
        assert spark.table(name).count() == 42


def test_a_view_over_a_streaming_sink_is_always_current(spark, name, folder):
    _stream_more(spark, folder)
    register_sink(spark, name, S.SCORED, folder("sink"))
    assert spark.table(name).count() == 30
    assert spark.table(name).columns == S.SCORED.names

    _stream_more(spark, folder, 12)
    assert spark.table(name).count() == 42
    repair_partitions(spark, name)

    # A file that no batch committed, as a failed attempt leaves behind.
    blocked = spark.table(name).filter("Risk_Action = 'BLOCK_CARD'")
    n_blocked, stray = blocked.count(), Path(folder("sink"), "Risk_Action=BLOCK_CARD")
    file = next(stray.glob("*.parquet"))
    shutil.copy(file, stray / "part-stray.snappy.parquet")
    assert spark.table(name).filter("Risk_Action = 'BLOCK_CARD'").count() == n_blocked
    assert re.search(r"PartitionFilters: \[.*BLOCK_CARD", formatted_plan(blocked))

    drop_table(spark, name)
    assert not spark.catalog.tableExists(name)


def test_setup_on_a_streaming_sink(spark, name, folder):
    _stream_more(spark, folder)
    run_daily(spark, folder("sink"), folder("daily"), table=None)
    names = f"{name}_tx", f"{name}_day", f"{name}_view"
    for _ in range(2):
        setup_catalog(spark, folder("sink"), folder("daily"), *names)
    rows = spark.table(names[2]).collect()
    assert len(rows) == 30 and {r["total_transactions"] for r in rows} == {30}


def test_setup_and_overview(spark, name, folder):
    write_scored(_scored(spark), folder("scored"))
    run_daily(spark, folder("scored"), folder("daily"), table=None)
    names = f"{name}_tx", f"{name}_day", f"{name}_view"
    for _ in range(2):
        setup_catalog(spark, folder("scored"), folder("daily"), *names)
    rows = spark.table(names[2]).collect()
    assert len(rows) == 20 and {r["total_transactions"] for r in rows} == {20}
    assert rows[0].asDict().keys() == {
        "event_ts",
        "Amount",
        "Class",
        "Risk_Action",
        "total_transactions",
        "total_fraud_transactions",
        "avg_amount",
    }


def test_daily_job_repairs_other_tables_and_limits_its_days(spark, name, folder):
    tx = f"{name}_tx"
    write_scored(_scored(spark, 10), folder("scored"))
    write_scored(_scored(spark, 5, "2025-01-02"), folder("scored"), mode="append")
    register_partitioned(spark, tx, S.SCORED, "Risk_Action", folder("scored"))
    run_daily(spark, folder("scored"), folder("daily"), name, repair=[tx])
    assert spark.table(tx).count() == 15
    assert spark.table(name).count() == 2

    write_scored(_scored(spark, 5, "2025-01-02"), folder("scored"), mode="append")
    run_daily(spark, folder("scored"), folder("daily"), name, since=dt.date(2025, 1, 2))
    rows = spark.table(name).collect()
    totals = {str(r["transaction_date"]): r["total_transactions"] for r in rows}
    assert totals == {"2025-01-01": 10, "2025-01-02": 10}


def test_rows_without_a_time_stay_out_of_the_daily_totals(spark):
    tx = transactions(spark, [("bad", 1.0, 0)]).selectExpr("*", "'ALLOW' AS Risk_Action")
    assert daily_aggregates(tx).count() == 0
