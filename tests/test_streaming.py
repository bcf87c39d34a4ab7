from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from helpers import physical_plan, transactions, utc, wire_rows
from riskflow import schema as S
from riskflow import streaming as st
from riskflow.functions import parse_event_time
from riskflow.operators import (
    alert_cells,
    alerts,
    to_envelope,
    window_aggregates,
    with_alert_key,
    with_risk_action,
)
from riskflow.operators.wire import REASON
from riskflow.plans import run_stream
from riskflow.session import ROCKSDB_PROVIDER, use_rocksdb_state
from riskflow.sinks import write_envelope_files
from riskflow.sources import read_envelope_files, read_scored
from riskflow.storage import child_names, make_older
from riskflow.streaming.fanout import (
    decode_messages,
    label_messages,
    score_labelled,
    start_followers,
    start_scoring,
)

ROWS = "eventTime string, Amount double, Class int"


def _score(df):
    """Row i of ten scores i/10."""
    return df.withColumn("Fraud_Probability", F.col("V1") % 10 / 10)


class WindowRun:
    """A window query that is run to its end once per delivered batch."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options = spark, folder, options
        self.seen = set()

    def deliver(self, rows):
        self.spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(
            self.folder("in")
        )
        stream = self.spark.readStream.schema(ROWS).parquet(self.folder("in"))
        stream = stream.withColumn("event_ts", parse_event_time("eventTime"))
        query = st.write_windows_stream(
            window_aggregates(stream, **self.options),
            self.folder("out"),
            self.folder("check"),
            st.RUN_TO_COMPLETION,
        )
        query.awaitTermination()
        dropped = sum(
            operator["numRowsDroppedByWatermark"]
            for progress in query.recentProgress
            for operator in progress["stateOperators"]
        )
        emitted = {
            (r["start"].strftime("%H:%M"), r["total_txn"], r["avg_amount"], r["fraud_count"])
            for r in self.spark.read.parquet(self.folder("out"))
            .select(F.col("window.start").cast("timestamp_ntz").alias("start"), "*")
            .collect()
        }
        new = emitted - self.seen
        self.seen |= new
        return new, dropped


def _at(clock):
    return f"2025-01-01T{clock}:00Z"


@pytest.mark.parametrize("provider", [None, ROCKSDB_PROVIDER])
def test_late_data_and_emission(spark, folder, provider):
    key = "spark.sql.streaming.stateStore.providerClass"
    if provider:
        use_rocksdb_state(spark)
    try:
        run = WindowRun(spark, folder)
        assert run.deliver([(_at("00:01"), 1.0, 0), (_at("00:07"), 2.0, 1)]) == (set(), 0)
        assert run.deliver([(_at("00:40"), 3.0, 0)]) == (
            {("23:55", 1, 1.0, 0), ("00:00", 2, 1.5, 1), ("00:05", 1, 2.0, 1)},
            0,
        )
        late = [(_at("00:02"), 9.0, 1), (_at("00:31"), 4.0, 1), ("bad", 5.0, 0)]
        assert run.deliver(late) == (set(), 2)
        assert run.deliver([(_at("02:00"), 7.0, 0)]) == (
            {
                ("00:25", 1, 4.0, 1),
                ("00:30", 1, 4.0, 1),
                ("00:35", 1, 3.0, 0),
                ("00:40", 1, 3.0, 0),
            },
            0,
        )
    finally:
        spark.conf.unset(key)


def test_a_longer_watermark_keeps_late_rows(spark, folder):
    run = WindowRun(spark, folder, watermark="2 hours")
    run.deliver([(_at("00:40"), 3.0, 0)])
    assert run.deliver([(_at("00:02"), 9.0, 1)]) == (set(), 0)


def _deliver_alerts(spark, folder, part, n=10):
    times = lambda i: f"2025-01-0{part}T00:00:{i:02d}Z"
    write_envelope_files(to_envelope(wire_rows(spark, n, eventTime=times)), folder("messages"))


def _run_alerts(spark, folder, checkpoint="check"):
    valid, _ = decode_messages(read_envelope_files(spark, folder("messages"), numbered=True))
    rows = alerts(with_risk_action(_score(valid)), keep=["message_id"])
    st.write_alerts_stream(
        with_alert_key(rows, ["message_id"]),
        folder("alerts"),
        folder(checkpoint),
        st.RUN_TO_COMPLETION,
    ).awaitTermination()


def test_alerts_are_keyed_text_and_survive_a_replayed_batch(spark, folder):
    _deliver_alerts(spark, folder, 1)
    _run_alerts(spark, folder)
    stored = spark.read.parquet(folder("alerts")).drop("batch_id")
    assert {t for _, t in stored.dtypes} == {"string"}
    first = sorted(stored.collect())
    assert len(first) == 6 and len({r["alert_key"] for r in first}) == 6

    # Forget that batch 0 was committed, as after a crash: the start replays it.
    for file in ("0", ".0.crc"):
        Path(folder("check"), "commits", file).unlink()
    _run_alerts(spark, folder)
    assert sorted(spark.read.parquet(folder("alerts")).drop("batch_id").collect()) == first

    _deliver_alerts(spark, folder, 2)
    _run_alerts(spark, folder)
    assert spark.read.parquet(folder("alerts")).count() == 12


def test_a_batch_without_alerts_writes_nothing(spark, folder):
    _deliver_alerts(spark, folder, 1, n=3)
    _run_alerts(spark, folder)
    assert child_names(spark, folder("alerts")) == ["_owner"]


def test_alert_cells_keep_null(spark, folder):
    rows = spark.createDataFrame(
        [(None, None, 0.9, "BLOCK_CARD", 1)],
        "eventTime string, Amount double, Fraud_Probability double, Risk_Action string, id int",
    )
    row = alert_cells(with_alert_key(alerts(rows, keep=["id"]), ["id"])).first()
    assert row["Amount"] is None and row["eventTime"] is None and row["alert_key"] == "unknown_1"


def _scored_query(spark, folder, checkpoint):
    valid, _ = decode_messages(read_envelope_files(spark, folder("messages")))
    return st.write_scored_stream(
        with_risk_action(_score(valid)), folder("out"), folder(checkpoint), st.RUN_TO_COMPLETION
    )


def test_restart_neither_loses_nor_doubles(spark, folder):
    for part in (1, 2):
        rows = wire_rows(spark, 20, Time=lambda i, p=part: float(100 * p + i))
        write_envelope_files(to_envelope(rows), folder("messages"))
        _scored_query(spark, folder, "check").awaitTermination()
    _scored_query(spark, folder, "check").awaitTermination()
    times = [r["Time"] for r in read_scored(spark, folder("out")).select("Time").collect()]
    assert len(times) == 40 and len(set(times)) == 40


def test_the_scored_sink_names_each_column_once(spark, folder):
    write_envelope_files(to_envelope(wire_rows(spark, 5)), folder("messages"))
    _scored_query(spark, folder, "check").awaitTermination()
    assert sorted(spark.read.parquet(folder("out")).columns) == sorted(S.SCORED.names)


def test_a_new_checkpoint_on_a_used_sink_is_refused(spark, folder):
    write_envelope_files(to_envelope(wire_rows(spark, 10)), folder("messages"))
    _scored_query(spark, folder, "check").awaitTermination()
    with pytest.raises(st.StaleCheckpointError):
        _scored_query(spark, folder, "other")
    assert read_scored(spark, folder("out")).count() == 10


def test_a_shorter_foreign_checkpoint_is_refused(spark, folder):
    for _ in range(2):
        write_envelope_files(to_envelope(wire_rows(spark, 10)), folder("messages"))
        _scored_query(spark, folder, "check").awaitTermination()
    valid, _ = decode_messages(read_envelope_files(spark, folder("messages")))
    rows = with_risk_action(_score(valid))
    st.write_scored_stream(
        rows, folder("elsewhere"), folder("foreign"), st.RUN_TO_COMPLETION
    ).awaitTermination()
    with pytest.raises(st.StaleCheckpointError):
        st.write_scored_stream(rows, folder("out"), folder("foreign"), st.RUN_TO_COMPLETION)


def _plain_query(spark, folder, out, checkpoint):
    valid, _ = decode_messages(read_envelope_files(spark, folder("messages")))
    rows = with_risk_action(_score(valid))
    return st.write_scored_stream(rows, folder(out), folder(checkpoint), st.RUN_TO_COMPLETION)


@pytest.mark.parametrize("longer", [0, 1])
def test_an_equally_long_or_longer_foreign_checkpoint_is_refused(spark, folder, longer):
    """What counts is whose checkpoint it is, not how many batches it has."""
    for run in range(2):
        write_envelope_files(to_envelope(wire_rows(spark, 10)), folder("messages"))
        if run >= longer:
            _plain_query(spark, folder, "out", "check").awaitTermination()
        _plain_query(spark, folder, "elsewhere", "foreign").awaitTermination()
    with pytest.raises(st.StaleCheckpointError):
        _plain_query(spark, folder, "out", "foreign")
    _plain_query(spark, folder, "out", "check").awaitTermination()
    assert read_scored(spark, folder("out")).count() == 20


def test_windows_and_alerts_refuse_a_foreign_checkpoint_of_their_length(spark, folder):
    _deliver_alerts(spark, folder, 1)
    _run_alerts(spark, folder)
    _plain_query(spark, folder, "elsewhere", "foreign").awaitTermination()
    with pytest.raises(st.StaleCheckpointError):
        _run_alerts(spark, folder, "foreign")
    run = WindowRun(spark, lambda label: folder(f"windows-{label}"))
    run.deliver([(_at("00:01"), 1.0, 0)])
    with pytest.raises(st.StaleCheckpointError):
        st.write_windows_stream(
            spark.readStream.schema(ROWS).parquet(folder("windows-in")),
            folder("windows-out"),
            folder("foreign"),
        )


def test_an_owned_sink_is_not_listed_at_the_start(spark, folder, monkeypatch):
    _deliver_alerts(spark, folder, 1)
    _run_alerts(spark, folder)

    def fail(*_):
        raise AssertionError("listed")

    monkeypatch.setattr("riskflow.streaming.guards.highest_number", fail)
    _deliver_alerts(spark, folder, 2)
    _run_alerts(spark, folder)
    assert spark.read.parquet(folder("alerts")).count() == 12


def test_messages_are_read_and_parsed_once_for_all_outputs(spark, folder):
    write_envelope_files(to_envelope(wire_rows(spark, 5)), folder("messages"))
    messages = spark.read.text(folder("messages"))
    plan = physical_plan(score_labelled(label_messages(messages), _score))
    assert plan.count("FileScan") == 1 and plan.count("from_json") == 1


def test_rejected_rows_keep_their_text_and_have_no_score(spark, folder):
    paths = st.StreamPaths(folder("job"))
    messages = _messages_with_faults(spark, folder)
    st.await_each(start_scoring(messages, _score, paths, st.RUN_TO_COMPLETION).values())
    stored = spark.read.parquet(paths.scored)
    rejected = stored.filter("outcome = 'rejected'").collect()
    assert len(rejected) == 3 and stored.count() == 33
    assert all(r["Fraud_Probability"] is None and r["V1"] is None for r in rejected)
    assert all(r["payload"] is None for r in stored.filter("outcome = 'scored'").collect())
    assert read_scored(spark, paths.scored).count() == 30


def test_files_of_any_age_are_read_unless_limited(spark, folder):
    for limit, rows in ((None, 20), ("7d", 10)):
        source, out = folder(f"in-{limit}"), folder(f"out-{limit}")
        options = {} if limit is None else {"max_file_age": limit}
        for late in (False, True):
            before = set(child_names(spark, source))
            write_envelope_files(to_envelope(wire_rows(spark, 10)).coalesce(1), source)
            if late:
                for name in set(child_names(spark, source)) - before:
                    make_older(spark, f"{source}/{name}", 30 * 24 * 3600 * 1000)
            stream = read_envelope_files(spark, source, **options).select("value")
            check = folder(f"check-{limit}")
            st.write_parquet_stream(stream, out, check, st.RUN_TO_COMPLETION).awaitTermination()
        assert spark.read.parquet(out).count() == rows


def test_equal_messages_have_different_keys_that_a_replay_repeats(spark, folder):
    twice = to_envelope(wire_rows(spark, 10))
    write_envelope_files(twice.unionByName(twice), folder("messages"))
    _run_alerts(spark, folder)
    first = sorted(r["alert_key"] for r in spark.read.parquet(folder("alerts")).collect())
    assert len(first) == 12 and len(set(first)) == 12
    for file in ("0", ".0.crc"):
        Path(folder("check"), "commits", file).unlink()
    _run_alerts(spark, folder)
    assert sorted(r["alert_key"] for r in spark.read.parquet(folder("alerts")).collect()) == first


def test_numbered_files_have_the_lines_of_plain_ones(spark, folder):
    Path(folder("in")).mkdir()
    for i, text in enumerate(["a\nb\r\nc", "d\n", "", "\n\ne\n", "x\ry"]):
        Path(folder("in"), f"f{i}.txt").write_bytes(text.encode())
    stream = read_envelope_files(spark, folder("in"), numbered=True)
    st.write_parquet_stream(
        stream, folder("out"), folder("check"), st.RUN_TO_COMPLETION
    ).awaitTermination()
    rows = spark.read.parquet(folder("out")).collect()
    assert sorted(r["value"] for r in rows) == sorted(
        r["value"] for r in spark.read.text(folder("in")).collect()
    )
    places = {(r["file"][-6:-4], r["line"]): r["value"] for r in rows}
    assert len(places) == len(rows) == 9
    assert places["f0", 2] == "c" and places["f3", 2] == "e"


def _numbered(spark, folder, out, **options):
    stream = read_envelope_files(spark, folder("in"), numbered=True, **options)
    query = st.write_parquet_stream(
        stream, folder(out), folder(f"check-{out}"), st.RUN_TO_COMPLETION
    )
    query.awaitTermination()
    return query, spark.read.parquet(folder(out))


def test_numbered_files_are_read_line_by_line_and_not_split(spark, folder):
    Path(folder("in")).mkdir()
    # Over more than one Arrow batch a file, and in one task with others.
    for name, n in (("a.txt", 25_000), ("b.txt", 3), ("c.txt", 40_000), ("d.txt", 1)):
        Path(folder("in"), name).write_text("".join(f"{i % 7}:{i}\n" for i in range(n)))
    keys = {
        "spark.sql.files.maxPartitionBytes": "20000",
        "spark.sql.files.openCostInBytes": "1",
    }
    for out, conf in (("pieces", keys), ("together", {})):
        before = {key: spark.conf.get(key) for key in conf}
        for key, value in conf.items():
            spark.conf.set(key, value)
        try:
            query, rows = _numbered(spark, folder, out)
        finally:
            for key, value in before.items():
                spark.conf.set(key, value)
        # No row is a whole file: the source's rows are the lines.
        assert sum(p["numInputRows"] for p in query.recentProgress) == 65_004
        assert rows.count() == 65_004
        assert rows.filter("value <> concat(line % 7, ':', line)").count() == 0


def test_files_that_spark_splits_are_not_numbered_unless_their_suffix_is_given(spark, folder):
    Path(folder("in")).mkdir()
    Path(folder("in"), "a.json").write_text("".join(f"{i}\n" for i in range(20_000)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "20000")
    try:
        with pytest.raises(StreamingQueryException, match="cannot number the lines"):
            _numbered(spark, folder, "split")
        _, rows = _numbered(spark, folder, "whole", suffix=".json")
    finally:
        spark.conf.set(key, before)
    assert rows.filter("value = line").count() == rows.count() == 20_000


def test_a_keyed_store_needs_positions(spark, folder):
    Path(folder("in")).mkdir()
    messages = read_envelope_files(spark, folder("in"))
    with pytest.raises(ValueError, match="position"):
        run_stream(spark, messages, None, st.StreamPaths(folder("job")), alert_store=lambda *_: None)


@pytest.mark.parametrize(
    ("value", "text"),
    [
        (12345678.9, "12345678.9"),
        (10_000_000.0, "10000000.0"),
        (1.5, "1.5"),
        (-98765432.125, "-98765432.125"),
        (0.00012, "0.00012"),
        (0.0, "0.0"),
        (None, None),
        (1234567.25, "1234567.25"),
    ],
)
def test_amounts_are_plain_text(spark, value, text):
    rows = spark.createDataFrame(
        [("t", value, 0.9, "BLOCK_CARD", "k")],
        "eventTime string, Amount double, Fraud_Probability double, Risk_Action string, alert_key string",
    )
    assert alert_cells(rows).first()["Amount"] == text


def test_the_alert_sink_is_guarded_too(spark, folder):
    _deliver_alerts(spark, folder, 1)
    _run_alerts(spark, folder)
    with pytest.raises(st.StaleCheckpointError):
        _run_alerts(spark, folder, "other")


def _messages_with_faults(spark, folder):
    good = to_envelope(wire_rows(spark, 30))
    bad = spark.createDataFrame([("{broken",), ('{"Amount":1.0}',), ("",)], "value string")
    write_envelope_files(good.unionByName(bad), folder("messages"))
    return read_envelope_files(spark, folder("messages"), numbered=True)


@pytest.mark.parametrize("follow", [False, True])
def test_one_stream_feeds_every_output(spark, folder, follow):
    messages, paths = _messages_with_faults(spark, folder), st.StreamPaths(folder("job"))
    if follow:
        st.await_each(start_scoring(messages, _score, paths, st.RUN_TO_COMPLETION).values())
        st.await_each(
            start_followers(spark, paths, st.RUN_TO_COMPLETION, watermark="0 minutes").values()
        )
    else:
        st.await_each(
            st.start_all(
                messages, _score, paths, st.RUN_TO_COMPLETION, watermark="0 minutes"
            ).values()
        )
    assert read_scored(spark, paths.scored).count() == 30
    found = {r["alert_key"] for r in spark.read.parquet(paths.alerts).collect()}
    assert len(found) == 18
    # Both ways give an alert the key that its message has: its place in a file.
    files = {r[0] for r in spark.read.text(folder("messages")).select("_metadata.file_path").collect()}
    assert {key.split("_", 1)[1].rsplit("-", 1)[0] for key in found} <= files
    # One row a minute until 00:29: the windows that end by then are closed.
    closed = spark.read.parquet(paths.windows).select("total_txn").collect()
    assert sorted(r["total_txn"] for r in closed) == [5, 10, 10, 10, 10]
    rejects = spark.read.parquet(paths.rejects)
    assert {r["payload"]: r[REASON] for r in rejects.collect()} == {
        "{broken": "bad_json",
        '{"Amount":1.0}': "bad_feature",
        "": "bad_json",
    }


def test_followers_skip_the_allow_folder(spark, folder):
    paths = st.StreamPaths(folder("job"))
    st.await_each(
        start_scoring(
            _messages_with_faults(spark, folder), _score, paths, st.RUN_TO_COMPLETION
        ).values()
    )
    started = start_followers(spark, paths, st.RUN_TO_COMPLETION)
    st.await_each(started.values())
    # 12 of the 30 rows are ALLOW and are never read for alerts. The other 18 are read
    # to see whether there are any, and to be stored.
    assert started["alerts"].recentProgress[0]["numInputRows"] == 2 * 18


def test_processing_time_trigger_keeps_running(spark, folder):
    write_envelope_files(to_envelope(wire_rows(spark, 10)), folder("messages"))
    valid, _ = decode_messages(read_envelope_files(spark, folder("messages")))
    query = st.write_scored_stream(
        with_risk_action(_score(valid)),
        folder("out"),
        folder("check"),
        {"processingTime": "1 second"},
    )
    try:
        query.processAllAvailable()
        assert query.isActive
        write_envelope_files(to_envelope(wire_rows(spark, 5)), folder("messages"))
        query.processAllAvailable()
    finally:
        query.stop()
    assert read_scored(spark, folder("out")).count() == 15


def test_bounded_micro_batches_give_the_same_rows(spark, folder):
    write_envelope_files(to_envelope(wire_rows(spark, 40)).repartition(4), folder("messages"))
    source = read_envelope_files(spark, folder("messages"), max_files_per_trigger=1)
    valid, _ = decode_messages(source)
    query = st.write_scored_stream(
        with_risk_action(_score(valid)), folder("out"), folder("check"), st.RUN_TO_COMPLETION
    )
    query.awaitTermination()
    assert len(query.recentProgress) >= 4
    assert read_scored(spark, folder("out")).count() == 40


def test_stream_and_batch_windows_agree_on_closed_windows(spark, folder):
    rows = [(f"2025-01-01T{i // 60:02d}:{i % 60:02d}:30Z", float(i), i % 2) for i in range(300)]
    run = WindowRun(spark, folder)
    run.deliver(rows)
    batch = window_aggregates(transactions(spark, rows)).select(
        F.col("window.start").cast("timestamp_ntz").alias("start"),
        F.col("window.end").cast("timestamp_ntz").alias("end"),
        "*",
    )
    closed = {
        (r["start"].strftime("%H:%M"), r["total_txn"], r["avg_amount"], r["fraud_count"])
        for r in batch.collect()
        if r["end"] <= utc("2025-01-01T04:49:30")
    }
    assert run.seen == closed


def test_followers_start_before_anything_is_scored(spark, folder):
    """Followers start on an empty root and run beside the scoring."""
    source, paths = folder("messages"), st.StreamPaths(folder("job"))
    write_envelope_files(to_envelope(wire_rows(spark, 0)), source)
    trigger = {"processingTime": "1 second"}
    messages = read_envelope_files(spark, source)
    followers = start_followers(spark, paths, trigger, watermark="0 minutes")
    started = start_scoring(messages, _score, paths, trigger) | followers
    try:
        for n in (30, 10):
            write_envelope_files(to_envelope(wire_rows(spark, n)), source)
            for query in started.values():
                query.processAllAvailable()
        assert all(query.isActive for query in started.values())
    finally:
        for query in started.values():
            query.stop()
    assert read_scored(spark, paths.scored).count() == 40
    assert spark.read.parquet(paths.alerts).count() == 18 + 6
    assert spark.read.parquet(paths.windows).count() == 5
