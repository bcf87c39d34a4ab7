import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import physical_plan, wire_rows
from riskflow import streaming as st
from riskflow.operators import (
    daily_aggregates,
    daily_from_partials,
    daily_partials,
    merge_partials,
    with_event_ts,
    with_risk_action,
)
from riskflow.plans import daily_state, run_daily_incremental
from riskflow.plans import incremental
from riskflow.sinks import write_scored
from riskflow.sources import change_partitions, read_daily, read_scored, register_partitioned
from riskflow.storage import files_below


def _scored(spark, n, first_day, days=2):
    rows = wire_rows(
        spark,
        n,
        eventTime=lambda i: f"2025-01-{first_day + i % days:02d}T00:00:{i % 60:02d}Z" if i % 7 else "garbage",
        Amount=lambda i: None if i % 5 == 0 else i / 8,
    )
    return with_risk_action(
        with_event_ts(rows).withColumn("Fraud_Probability", F.col("V1") % 10 / 10)
    )


def _rows(daily):
    columns = ["transaction_date", *sorted(c for c in daily.columns if c != "transaction_date")]
    return sorted((tuple(r) for r in daily.select(*columns).collect()), key=lambda r: r[0])


def _run(spark, folder, **options):
    query = run_daily_incremental(
        spark, folder("scored"), folder("daily"), folder("check"), **options
    )
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def _expected(spark, folder):
    return _rows(daily_aggregates(read_scored(spark, folder("scored"))))


def test_merged_partials_are_the_totals(spark):
    scored = _scored(spark, 100, 1).unionByName(_scored(spark, 40, 2))
    parts = [scored.filter(F.col("V2") % 3 == k) for k in range(3)]
    states = [daily_partials(part) for part in parts]
    merged = merge_partials(states[2].unionByName(states[0]).unionByName(states[1]))
    assert _rows(daily_from_partials(merged)) == _rows(daily_aggregates(scored))


def test_amounts_that_are_all_missing_or_odd(spark):
    scored = _scored(spark, 12, 1).withColumn("Amount", F.lit(None).cast("double"))
    odd = _scored(spark, 12, 3).withColumn("Amount", F.lit(float("nan")))
    for rows in (scored, odd):
        again = daily_from_partials(merge_partials(daily_partials(rows).unionByName(daily_partials(rows))))
        assert str(_rows(again)) == str(_rows(daily_aggregates(rows.unionByName(rows))))


def test_a_run_opens_only_new_files(spark, folder):
    """Files that were counted may be unreadable afterwards."""
    write_scored(_scored(spark, 60, 1), folder("scored"))
    assert _run(spark, folder) == 60
    first = files_below(spark, folder("scored"))
    assert _rows(read_daily(spark, folder("daily"))) == _expected(spark, folder)

    write_scored(_scored(spark, 30, 2), folder("scored"), mode="append")
    expected = _expected(spark, folder)
    for file in first:
        path = Path(folder("scored"), file)
        path.write_bytes(b"gone")
        path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    assert _run(spark, folder) == 30
    assert _rows(read_daily(spark, folder("daily"))) == expected
    assert _run(spark, folder) == 0


def test_late_rows_change_their_old_day_and_no_other(spark, folder):
    write_scored(_scored(spark, 60, 1, days=5), folder("scored"))
    _run(spark, folder)
    times = {f: Path(folder("daily"), f).stat().st_mtime_ns for f in files_below(spark, folder("daily"))}
    write_scored(_scored(spark, 10, 2, days=1), folder("scored"), mode="append")
    _run(spark, folder)
    assert _rows(read_daily(spark, folder("daily"))) == _expected(spark, folder)
    now = set(files_below(spark, folder("daily")))
    changed = {f.split("/")[0] for f in times.keys() ^ now}
    assert changed == {"transaction_date=2025-01-02"}
    assert all(Path(folder("daily"), f).stat().st_mtime_ns == t for f, t in times.items() if f in now)


@pytest.mark.parametrize("fails_after", ["write_daily", "state"])
def test_a_batch_that_failed_half_way_is_repeated(spark, folder, monkeypatch, fails_after):
    write_scored(_scored(spark, 60, 1), folder("scored"))
    _run(spark, folder)
    write_scored(_scored(spark, 30, 2), folder("scored"), mode="append")
    write = incremental.write_daily

    def broken(*args, **options):
        if fails_after == "write_daily":
            write(*args, **options)
        raise RuntimeError("broken off")

    monkeypatch.setattr(incremental, "write_daily", broken)
    with pytest.raises(Exception, match="broken off"):
        _run(spark, folder)
    monkeypatch.setattr(incremental, "write_daily", write)
    assert _run(spark, folder) == 30
    assert _rows(read_daily(spark, folder("daily"))) == _expected(spark, folder)


def test_it_follows_the_commit_log_of_a_sink(spark, folder):
    """Files of a batch that was not committed are not counted."""

    def stream_more(day):
        write_scored(_scored(spark, 20, day), folder("in"), mode="append")
        stream = spark.readStream.schema(spark.read.parquet(folder("in")).schema).parquet(folder("in"))
        st.write_scored_stream(
            stream, folder("scored"), folder("stream-check"), st.RUN_TO_COMPLETION
        ).awaitTermination()

    for day in (1, 2, 2):
        stream_more(day)
        write_scored(_scored(spark, 5, 1), folder("stray"))
        for n, file in enumerate(files_below(spark, folder("stray"))):
            target = Path(folder("scored"), Path(file).parent, f"stray-{day}-{n}.parquet")
            target.parent.mkdir(exist_ok=True)
            target.write_bytes(Path(folder("stray"), file).read_bytes())
        _run(spark, folder, max_files=1)
        assert _rows(read_daily(spark, folder("daily"))) == _expected(spark, folder)
    assert sum(r["total_transactions"] for r in read_daily(spark, folder("daily")).collect()) == 51


def test_the_state_is_a_row_per_day_and_two_versions_at_most(spark, folder):
    for day in (1, 2, 3, 4):
        write_scored(_scored(spark, 20, day), folder("scored"), mode="append")
        _run(spark, folder)
    state = daily_state(spark, folder("check"))
    assert state.count() == 5
    assert len([p for p in Path(folder("check-state")).iterdir()]) <= 2
    assert daily_state(spark, folder("nothing")) is None


def test_changed_partitions_are_told_and_nothing_is_listed(spark, name, folder, monkeypatch):
    """Only ADD PARTITION is sent, and a stray folder stays unknown."""
    said = []
    ask = type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **k: said.append(text) or ask(self, text, *a, **k))
    for day in (1, 3):
        write_scored(_scored(spark, 20, day), folder("scored"), mode="append")
        _run(spark, folder, table=name)
    assert not any("MSCK" in text for text in said)
    assert sum("ADD IF NOT EXISTS" in text for text in said) == 2
    Path(folder("daily"), "transaction_date=1999-01-01").mkdir()
    days = [dt.date(2025, 1, d) for d in (1, 2, 3, 4)]
    listed = [r[0] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()]
    assert sorted(listed) == [f"transaction_date={d}" for d in days]
    assert _rows(spark.table(name)) == _expected(spark, folder)


def test_partitions_come_and_go_in_bulk(spark, name, folder, monkeypatch):
    from riskflow import schema as S
    from riskflow.sources import catalog

    monkeypatch.setattr(catalog, "_AT_ONCE", 2)
    register_partitioned(spark, name, S.DAILY, "transaction_date", folder("daily"))
    days = [dt.date(2025, 1, d) for d in range(1, 6)]
    change_partitions(spark, name, "transaction_date", folder("daily"), present=days)
    change_partitions(spark, name, "transaction_date", folder("daily"), gone=[*days[:3], dt.date(1999, 1, 1)])
    listed = [r[0] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()]
    assert sorted(listed) == [f"transaction_date={d}" for d in days[3:]]


def test_partials_combine_before_their_shuffle(spark, folder):
    write_scored(_scored(spark, 20, 1), folder("scored"))
    plan = physical_plan(daily_partials(read_scored(spark, folder("scored"))))
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2
