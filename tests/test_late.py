import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import utc, wire_rows
from riskflow import streaming as st
from riskflow.functions import parse_event_time
from riskflow.operators import to_envelope, window_aggregates
from riskflow.sinks import write_envelope_files
from riskflow.sources import read_envelope_files

ROWS = "eventTime string, Amount double, Class int"
FIRST = [("2025-01-01T00:01:00Z", 1.0, 0), ("2025-01-01T00:07:00Z", 2.0, 1)]
SECOND = [("2025-01-01T00:40:00Z", 3.0, 0)]
LATE = [("2025-01-01T00:02:00Z", 9.0, 1), ("2025-01-01T00:31:00Z", 4.0, 1), ("bad", 5.0, 0)]
LAST = [("2025-01-01T02:00:00Z", 7.0, 0)]
LATER = [("2025-01-01T00:00:30Z", 7.0, 0), ("2025-01-01T00:01:30Z", 8.0, 0), ("2025-01-01T01:30:30Z", 7.0, 0)]


class Windows:
    """A window query over files, delivered one by one."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.dropped = spark, folder, 0

    def deliver(self, rows):
        # The source takes files by their time, to the millisecond.
        time.sleep(0.05)
        self.spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(self.folder("in"))

    def run(self, **options):
        reader = self.spark.readStream.schema(ROWS).options(**options)
        rows = reader.parquet(self.folder("in")).withColumn("event_ts", parse_event_time("eventTime"))
        query = st.write_windows_stream(
            window_aggregates(rows), self.folder("out"), self.folder("check"), st.RUN_TO_COMPLETION
        )
        query.awaitTermination()
        self.dropped += st.windows_dropped(query)
        return str(query.id)

    def read(self, files):
        rows = self.spark.read.schema(ROWS).parquet(*files or [self.folder("in")])
        return rows.withColumn("event_ts", parse_event_time("eventTime")).withColumn(
            "file", F.col("_metadata.file_path")
        )

    def collect(self):
        return st.collect_late(self.spark, self.folder("check"), self.read, self.folder("late"))

    def late(self):
        rows = st.read_late(self.spark, self.folder("late"))
        return sorted(
            (r["eventTime"], r["window"]["start"], r["batch_id"], r["late_before"])
            for r in rows.collect()
        )


@pytest.fixture
def windows(spark, folder):
    return Windows(spark, folder)


def _distinct(late):
    return len({(start, batch) for _, start, batch, _ in late})


def test_late_rows_of_each_run(windows):
    for rows in (FIRST, SECOND, LATE, LAST):
        windows.deliver(rows)
        windows.run()
    windows.collect()
    bound = utc("2025-01-01T00:30:00")
    assert [(t, start, bound_) for t, start, _, bound_ in windows.late()] == [
        ("2025-01-01T00:02:00Z", utc("2024-12-31T23:55:00"), bound),
        ("2025-01-01T00:02:00Z", utc("2025-01-01T00:00:00"), bound),
    ]
    assert windows.dropped == _distinct(windows.late()) == 2


def test_batches_of_one_run_are_bound_by_the_batch_before(windows):
    """In one run the watermark of a batch holds for the next one's late rows."""
    for rows in (FIRST, SECOND, LATE, LAST, LATER):
        windows.deliver(rows)
    windows.run(maxFilesPerTrigger=1)
    assert windows.collect() == 4
    late = windows.late()
    # The third batch was still bound by 23:57, the fifth by 00:30.
    assert [(t, start) for t, start, *_ in late] == [
        ("2025-01-01T00:00:30Z", utc("2024-12-31T23:55:00")),
        ("2025-01-01T00:00:30Z", utc("2025-01-01T00:00:00")),
        ("2025-01-01T00:01:30Z", utc("2024-12-31T23:55:00")),
        ("2025-01-01T00:01:30Z", utc("2025-01-01T00:00:00")),
    ]
    assert windows.dropped == _distinct(late) == 2


def test_collecting_goes_on_where_it_stopped(windows, folder):
    assert windows.collect() is None
    windows.deliver(FIRST)
    windows.run()
    first = windows.collect()
    assert windows.late() == []
    opened = []
    read = windows.read
    windows.read = lambda files: opened.append(files) or read(files)
    for rows in (SECOND, LATE):
        windows.deliver(rows)
        windows.run()
    second = windows.collect()
    assert second > first and len(opened) == 1 and len(opened[0]) == 2
    assert windows.collect() == second and len(opened) == 1
    expected = windows.late()
    # A collection that was broken off is not read, and is made again.
    for file in ("_SUCCESS", "._SUCCESS.crc"):
        Path(folder("late"), f"upto={second}", file).unlink()
    assert windows.late() == []
    assert windows.collect() == second
    assert windows.late() == expected != []


def test_a_forgotten_batch_is_an_error(windows, folder):
    for rows in (FIRST, SECOND):
        windows.deliver(rows)
        windows.run()
    Path(folder("check"), "offsets", "0").unlink()
    with pytest.raises(st.ForgottenBatchesError, match="forgotten batch 0"):
        windows.collect()


def test_the_listener_counts_what_is_collected(spark, windows):
    drops = st.WatermarkDrops()
    spark.streams.addListener(drops)
    try:
        for rows in (FIRST, SECOND, LATE, LAST, LATER):
            windows.deliver(rows)
            query = windows.run()
        windows.collect()
        wanted = _distinct(windows.late())
        for _ in range(100):  # it is told after the fact
            if drops.windows.get(query) == wanted:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(drops)
    assert drops.windows[query] == wanted == windows.dropped > 2


def test_late_rows_behind_the_scoring_query(spark, folder):
    """Followers read the stored rows; rejected messages are no late rows."""
    paths = st.StreamPaths(folder("stream"))

    def deliver(minute, n):
        rows = wire_rows(
            spark, n, eventTime=lambda i: f"2025-01-01T{minute}:00Z", Amount=lambda i: None if i == 1 else 2.0
        )
        write_envelope_files(to_envelope(rows), folder("in"))
        stream = read_envelope_files(spark, folder("in"))
        scorer = lambda df: df.withColumn("Fraud_Probability", F.lit(0.1))
        st.await_each(st.start_scoring(stream, scorer, paths, st.RUN_TO_COMPLETION).values())
        st.await_each(st.start_followers(spark, paths, st.RUN_TO_COMPLETION).values())

    for minute, n in (("00:05", 3), ("01:00", 1), ("00:06", 4)):
        deliver(minute, n)
    st.collect_late(spark, paths.checkpoint("windows"), st.stored_files(spark, paths.scored), paths.late)
    late = st.read_late(spark, paths.late)
    assert late.count() == 3 * 2
    assert {r["eventTime"] for r in late.collect()} == {"2025-01-01T00:06:00Z"}


def test_open_and_closed_windows(spark, windows, folder):
    check, out = folder("check"), folder("out")
    assert st.open_windows(spark, check).collect() == []
    assert st.current_windows(spark, out, check).collect() == []
    windows.deliver(FIRST)
    windows.run()
    held = {r["window"]["start"]: r for r in st.open_windows(spark, check).collect()}
    assert {k: (r["total_txn"], r["avg_amount"], r["fraud_count"]) for k, r in held.items()} == {
        utc("2024-12-31T23:55:00"): (1, 1.0, 0),
        utc("2025-01-01T00:00:00"): (2, 1.5, 1),
        utc("2025-01-01T00:05:00"): (1, 2.0, 1),
    }
    windows.deliver(SECOND)
    windows.run()
    rows = st.current_windows(spark, out, check).collect()
    assert {(r["window"]["start"], r["is_open"]) for r in rows} == {
        (utc("2024-12-31T23:55:00"), False),
        (utc("2025-01-01T00:00:00"), False),
        (utc("2025-01-01T00:05:00"), False),
        (utc("2025-01-01T00:35:00"), True),
        (utc("2025-01-01T00:40:00"), True),
    }
    assert st.open_windows(spark, check, batch=0).count() == 3


def test_amounts_that_are_all_missing_in_an_open_window(spark, windows, folder):
    windows.deliver([("2025-01-01T00:01:00Z", None, 1)])
    windows.run()
    assert {r["avg_amount"] for r in st.open_windows(spark, folder("check")).collect()} == {None}
