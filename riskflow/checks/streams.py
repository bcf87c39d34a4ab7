"""Checks of streaming sources, sinks, windows, late data, restart and fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow import fixtures, sinks, sources
from riskflow import operators as ops
from riskflow import schema as S
from riskflow import streaming as st
from riskflow.checks import sql
from riskflow.checks.batch import MAX_AVERAGE, MAX_TOTAL, plain_time, plain_windows
from riskflow.operators.wire import REASON
from riskflow.session import scratch_dir
from riskflow.storage import child_names, folder_bytes, make_older
from riskflow.streaming.fanout import decode_messages

# Rows of this type reach the two-step streams in the second step.
SECOND_STEP = "purchase"


def stand_in_scorer(df: DataFrame) -> DataFrame:
    """A score that SQL can repeat: V5 lies in [0, 1) and is on the wire."""
    return df.withColumn("Fraud_Probability", F.col("V5"))


def _finish(*queries) -> None:
    st.await_each(queries)


def _dirty_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "messages")
    messages = fixtures.messages(spark, sf_dir, dirty=True, broken=True)
    sinks.write_envelope_files(messages, path)
    return sources.read_envelope_files(spark, path)


def src_stream_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, root = scratch_dir(spark, "messages"), scratch_dir(spark, "stream")
    sinks.write_envelope_files(fixtures.messages(spark, sf_dir), messages)
    parsed = ops.parse_wire(sources.read_envelope_files(spark, messages))
    _finish(
        st.write_parquet_stream(parsed, f"{root}/out", f"{root}/check", st.RUN_TO_COMPLETION)
    )
    return spark.read.schema(S.WIRE).parquet(f"{root}/out")


def sink_stream_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = st.StreamPaths(scratch_dir(spark, "stream"))
    valid, _ = decode_messages(_dirty_messages(spark, sf_dir))
    scored = ops.with_risk_action(stand_in_scorer(valid))
    _finish(
        st.write_scored_stream(
            scored, paths.scored, paths.checkpoint("scored"), st.RUN_TO_COMPLETION
        )
    )
    return _plain_scored(sources.read_scored(spark, paths.scored))


def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = st.StreamPaths(scratch_dir(spark, "stream"))
    _, rejected = decode_messages(_dirty_messages(spark, sf_dir))
    _finish(
        st.write_parquet_stream(
            rejected, paths.rejects, paths.checkpoint("rejects"), st.RUN_TO_COMPLETION
        )
    )
    stored = spark.read.parquet(paths.rejects)
    time = F.get_json_object("payload", "$.Time").cast("double")
    return stored.select(REASON, time.alias("Time"))


def sink_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = st.StreamPaths(scratch_dir(spark, "stream"))
    scored = fixtures.tx_from_events(fixtures.events_stream(spark, sf_dir))
    keyed = ops.with_alert_key(ops.alerts(scored, keep=["event_id"]), ["event_id"])
    _finish(
        st.write_alerts_stream(
            keyed, paths.alerts, paths.checkpoint("alerts"), st.RUN_TO_COMPLETION
        )
    )
    cells = spark.read.parquet(paths.alerts)
    numbers = {c: F.col(c).cast("double") for c in ("Amount", "Fraud_Probability")}
    return cells.drop("batch_id").withColumns(numbers)


def stream_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = st.StreamPaths(scratch_dir(spark, "stream"))
    tx = fixtures.tx_from_events(fixtures.events_stream(spark, sf_dir))
    flagged = ops.window_anomalies(tx, max_total=MAX_TOTAL, max_average=MAX_AVERAGE)
    _finish(
        st.write_windows_stream(
            flagged, paths.windows, paths.checkpoint("windows"), st.RUN_TO_COMPLETION
        )
    )
    return plain_windows(spark.read.parquet(paths.windows))


def _in_two_steps(spark: SparkSession, rows: DataFrame, write, start) -> None:
    """Deliver rows in two steps; run the query to its end after each."""
    second = F.col("event_type") == SECOND_STEP
    for part in (rows.filter(~second), rows.filter(second)):
        write(part)
        _finish(start())


def _late_windows(spark: SparkSession, sf_dir: str) -> tuple[str, st.StreamPaths, int]:
    """A window query over events that come in two steps, the second one late.

    Returns the folder of the events, that of the outputs, and what Spark says it dropped.
    """
    source, paths = scratch_dir(spark, "events"), st.StreamPaths(scratch_dir(spark, "stream"))
    table, started = spark.read.parquet(f"{sf_dir}/events.parquet"), []

    def start():
        stream = spark.readStream.schema(table.schema).parquet(source)
        tx = fixtures.tx_from_events(stream.withColumn("ts", F.col("ts").cast("timestamp")))
        started.append(
            st.write_windows_stream(
                ops.window_aggregates(tx),
                paths.windows,
                paths.checkpoint("windows"),
                st.RUN_TO_COMPLETION,
            )
        )
        return started[-1]

    _in_two_steps(spark, table, lambda part: part.write.mode("append").parquet(source), start)
    return source, paths, sum(map(st.windows_dropped, started))


def stream_late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second step arrives behind the watermark of the first.

    Its rows count only in windows that were still open.
    """
    _, paths, _ = _late_windows(spark, sf_dir)
    return plain_windows(spark.read.parquet(paths.windows))


def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that ``stream_late_data`` leaves out, by window, beside Spark's own count."""
    source, paths, dropped = _late_windows(spark, sf_dir)

    def read(files: list[str]) -> DataFrame:
        rows = spark.read.parquet(*files or [source])
        return rows.select(
            "event_id", F.col("ts").cast("timestamp").alias("event_ts"), "_metadata.file_path"
        ).withColumnRenamed("file_path", "file")

    st.collect_late(spark, paths.checkpoint("windows"), read, paths.late)
    return st.read_late(spark, paths.late).select(
        "event_id",
        plain_time("window.start", "window_start"),
        plain_time("window.end", "window_end"),
        plain_time("late_before"),
        F.lit(dropped).cast("long").alias("windows_dropped"),
    )


def stream_open_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows that a query over all events still holds at its end."""
    paths = _all_windows(spark, sf_dir)
    return plain_windows(st.open_windows(spark, paths.checkpoint("windows")))


def stream_current_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed and open windows: together those of a batch over the same rows."""
    paths = _all_windows(spark, sf_dir)
    return plain_windows(st.current_windows(spark, paths.windows, paths.checkpoint("windows")))


def _all_windows(spark: SparkSession, sf_dir: str) -> st.StreamPaths:
    paths = st.StreamPaths(scratch_dir(spark, "stream"))
    tx = fixtures.tx_from_events(fixtures.events_stream(spark, sf_dir), dirty=True)
    windows = ops.window_aggregates(tx)
    check = paths.checkpoint("windows")
    _finish(st.write_windows_stream(windows, paths.windows, check, st.RUN_TO_COMPLETION))
    return paths


def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs on one checkpoint write every row exactly once."""
    source, paths = scratch_dir(spark, "messages"), st.StreamPaths(scratch_dir(spark, "stream"))

    def write(part: DataFrame) -> None:
        events = part.withColumn("ts", F.col("ts").cast("timestamp"))
        sinks.write_envelope_files(fixtures.envelopes(fixtures.tx_from_events(events)), source)

    def start():
        valid, _ = decode_messages(sources.read_envelope_files(spark, source))
        return st.write_scored_stream(
            ops.with_risk_action(stand_in_scorer(valid)),
            paths.scored,
            paths.checkpoint("scored"),
            st.RUN_TO_COMPLETION,
        )

    _in_two_steps(spark, spark.read.parquet(f"{sf_dir}/events.parquet"), write, start)
    return _plain_scored(sources.read_scored(spark, paths.scored))


def stream_old_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that arrive late and are thirty days old are read like any other."""
    source, paths = scratch_dir(spark, "messages"), st.StreamPaths(scratch_dir(spark, "stream"))
    month_ms = 30 * 24 * 3600 * 1000

    def write(part: DataFrame) -> None:
        before = set(child_names(spark, source))
        sinks.write_envelope_files(fixtures.envelopes(fixtures.tx_from_events(part)), source)
        if before:
            for name in set(child_names(spark, source)) - before:
                make_older(spark, f"{source}/{name}", month_ms)

    def start():
        parsed = ops.parse_wire(sources.read_envelope_files(spark, source))
        return st.write_parquet_stream(
            parsed, paths.scored, paths.checkpoint("scored"), st.RUN_TO_COMPLETION
        )

    _in_two_steps(spark, fixtures.events(spark, sf_dir), write, start)
    return spark.read.schema(S.WIRE).parquet(paths.scored)


def alert_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of messages that all come twice: every copy has a key of its own."""
    source, paths = scratch_dir(spark, "messages"), st.StreamPaths(scratch_dir(spark, "stream"))
    messages = fixtures.messages(spark, sf_dir)
    sinks.write_envelope_files(messages.unionByName(messages), source)
    stream = sources.read_envelope_files(spark, source, numbered=True)
    started = st.start_scoring(stream, stand_in_scorer, paths, st.RUN_TO_COMPLETION)
    st.await_each(started.values())
    st.await_each(st.start_followers(spark, paths, st.RUN_TO_COMPLETION).values())
    alerts = spark.read.parquet(paths.alerts)
    return alerts.groupBy("eventTime", "Amount", "Risk_Action").agg(
        F.count(F.lit(1)).alias("n_alerts"), F.countDistinct("alert_key").alias("n_keys")
    )


def stream_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per output of the scoring job, each output its own query."""
    paths = st.StreamPaths(scratch_dir(spark, "stream"))
    messages = _dirty_messages(spark, sf_dir)
    _finish(*st.start_all(messages, stand_in_scorer, paths, st.RUN_TO_COMPLETION).values())
    return _rows_per_output(spark, paths)


def stream_followers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with rejects, alerts and windows on top of the stored rows."""
    paths = st.StreamPaths(scratch_dir(spark, "stream"))
    messages = _dirty_messages(spark, sf_dir)
    scoring = st.start_scoring(messages, stand_in_scorer, paths, st.RUN_TO_COMPLETION)
    _finish(*scoring.values())
    _finish(*st.start_followers(spark, paths, st.RUN_TO_COMPLETION).values())
    return _rows_per_output(spark, paths)


def stream_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same once more, with followers that take a backlog in bounded batches.

    The stored files are in no order of time, so windows wait for all of them.
    """
    paths = st.StreamPaths(scratch_dir(spark, "stream"))
    messages = _dirty_messages(spark, sf_dir)
    _finish(*st.start_scoring(messages, stand_in_scorer, paths, st.RUN_TO_COMPLETION).values())
    a_quarter = folder_bytes(spark, paths.scored) // 4
    followers = st.start_followers(
        spark, paths, st.RUN_TO_COMPLETION, max_bytes=a_quarter, watermark="90 days"
    )
    _finish(*followers.values())
    windows = st.current_windows(spark, paths.windows, paths.checkpoint("windows"))
    batches = [p["batchId"] for p in followers["windows"].recentProgress if p["numInputRows"]]
    return _rows_per_output(spark, paths, windows).withColumn(
        "in_several_batches", F.lit(len(batches) > 1)
    )


def _rows_per_output(
    spark: SparkSession, paths: st.StreamPaths, windows: DataFrame | None = None
) -> DataFrame:
    windows = spark.read.parquet(paths.windows) if windows is None else windows

    def rows(output: str, df: DataFrame, label) -> DataFrame:
        return df.groupBy(label.alias("label")).agg(
            F.lit(output).alias("output"), F.count(F.lit(1)).alias("n_rows")
        )

    return (
        rows("scored", sources.read_scored(spark, paths.scored), F.col("Risk_Action"))
        .unionByName(rows("alerts", spark.read.parquet(paths.alerts), F.col("Risk_Action")))
        .unionByName(rows("windows", windows, F.col("total_txn").cast("string")))
        .unionByName(rows("rejects", spark.read.parquet(paths.rejects), F.col(REASON)))
    )


def _plain_scored(scored: DataFrame) -> DataFrame:
    return scored.withColumn("event_ts", plain_time("event_ts"))


QUERIES = {
    "src_stream_envelope": src_stream_envelope,
    "sink_stream_partitioned": sink_stream_partitioned,
    "stream_rejects": stream_rejects,
    "sink_alerts": sink_alerts,
    "stream_sliding_window": stream_sliding_window,
    "stream_late_data": stream_late_data,
    "stream_late_rows": stream_late_rows,
    "stream_open_windows": stream_open_windows,
    "stream_current_windows": stream_current_windows,
    "stream_restart": stream_restart,
    "stream_old_files": stream_old_files,
    "alert_keys": alert_keys,
    "stream_fanout": stream_fanout,
    "stream_followers": stream_followers,
    "stream_backlog": stream_backlog,
}


def _scored_on_v5(dirty: bool) -> str:
    """Adds ``valid`` (scorable rows, scored by V5) and ``rejected``."""
    bad = """event_id % 500 = 6 OR "Amount" IS NULL OR "V1" IS NULL""" if dirty else "false"
    scored_by_v5 = sql.TIER.replace('"Fraud_Probability"', '"V5"')
    return (
        sql.tx(dirty)
        + f""", valid AS (
  SELECT * REPLACE ("V5" AS "Fraud_Probability", {scored_by_v5} AS "Risk_Action")
  FROM tx WHERE NOT ({bad})
), rejected AS (
  SELECT *, CASE WHEN event_id % 500 = 6 THEN 'bad_json' ELSE 'bad_feature' END AS reject_reason
  FROM tx WHERE {bad}
)"""
    )


def _closed(windows: str, source: str) -> str:
    return f"""SELECT * FROM ({windows})
WHERE window_end <= (SELECT max(event_ts) FROM {source}) - INTERVAL 10 MINUTE"""


def _outputs(windows: str) -> str:
    return (
        _scored_on_v5(dirty=True)
        + f"""
SELECT 'scored' AS output, "Risk_Action" AS label, CAST(count(*) AS BIGINT) AS n_rows
FROM valid GROUP BY 2
UNION ALL
SELECT 'alerts', "Risk_Action", count(*) FROM valid WHERE "Risk_Action" <> 'ALLOW' GROUP BY 2
UNION ALL
SELECT 'windows', CAST(total_txn AS VARCHAR), count(*)
FROM ({windows}) GROUP BY 2
UNION ALL
SELECT 'rejects', reject_reason, count(*) FROM rejected GROUP BY 2"""
    )


_ALL_WINDOWS = sql.sliding("valid")
_OUTPUTS = _outputs(_closed(_ALL_WINDOWS, "valid"))

#: The watermark after the first step, and every row in each of its windows.
_LATE = (
    sql.tx()
    + f""", typed AS (SELECT tx.*, event_type = '{SECOND_STEP}' AS late
  FROM tx JOIN events USING (event_id)),
first_step AS (SELECT date_trunc('milliseconds', max(event_ts)) - INTERVAL 10 MINUTE AS mark
  FROM typed WHERE NOT late),
placed AS (
  SELECT *, time_bucket(INTERVAL 5 MINUTE, event_ts) - k * INTERVAL 5 MINUTE AS window_start
  FROM typed, (VALUES (0), (1)) AS shift(k))
"""
)

SQL = {
    "src_stream_envelope": sql.tx() + f" SELECT {sql.WIRE_COLUMNS} FROM tx",
    "sink_stream_partitioned": _scored_on_v5(dirty=True)
    + f" SELECT {sql.SCORED_COLUMNS} FROM valid",
    "stream_rejects": _scored_on_v5(dirty=True)
    + """ SELECT reject_reason,
  CASE WHEN reject_reason = 'bad_json' THEN NULL ELSE "Time" END AS "Time" FROM rejected""",
    "sink_alerts": sql.tx()
    + """ SELECT "eventTime" || '_' || event_id AS alert_key,
  "eventTime", "Amount", "Fraud_Probability", "Risk_Action"
FROM tx WHERE "Risk_Action" <> 'ALLOW'""",
    "stream_sliding_window": sql.tx()
    + f""" SELECT *, coalesce(total_txn > {MAX_TOTAL} OR avg_amount > {MAX_AVERAGE}, false)
  AS is_anomaly FROM ({_closed(sql.sliding(), "tx")})""",
    "stream_late_data": _LATE
    + """SELECT window_start, window_start + INTERVAL 10 MINUTE AS window_end,
  CAST(count(*) AS BIGINT) AS total_txn,
  round(avg("Amount"), 9) AS avg_amount,
  CAST(count(*) FILTER ("Class" = 1) AS BIGINT) AS fraud_count
FROM placed, first_step
WHERE (NOT late OR window_start + INTERVAL 10 MINUTE > mark)
  AND window_start + INTERVAL 20 MINUTE <= (SELECT max(event_ts) FROM tx)
GROUP BY window_start""",
    "stream_late_rows": _LATE
    + """SELECT event_id, window_start, window_start + INTERVAL 10 MINUTE AS window_end,
  mark AS late_before, CAST(dense_rank() OVER (ORDER BY window_start DESC)
    + dense_rank() OVER (ORDER BY window_start) - 1 AS BIGINT) AS windows_dropped
FROM placed, first_step WHERE late AND window_start + INTERVAL 10 MINUTE <= mark""",
    "stream_open_windows": sql.tx(dirty=True)
    + f""" SELECT * FROM ({sql.sliding()})
WHERE window_end > (SELECT max(event_ts) FROM tx) - INTERVAL 10 MINUTE""",
    "stream_current_windows": sql.tx(dirty=True)
    + f""" SELECT *, window_end > (SELECT max(event_ts) FROM tx) - INTERVAL 10 MINUTE AS is_open
FROM ({sql.sliding()})""",
    "stream_restart": _scored_on_v5(dirty=False) + f" SELECT {sql.SCORED_COLUMNS} FROM valid",
    "stream_old_files": sql.tx() + f" SELECT {sql.WIRE_COLUMNS} FROM tx",
    # Amounts are compared as text: the shortest decimal, as both engines write it here.
    "alert_keys": _scored_on_v5(dirty=False)
    + """ SELECT "eventTime", CAST("Amount" AS VARCHAR) AS "Amount", "Risk_Action",
  CAST(2 * count(*) AS BIGINT) AS n_alerts, CAST(2 * count(*) AS BIGINT) AS n_keys
FROM valid WHERE "Risk_Action" <> 'ALLOW' GROUP BY 1, 2, 3""",
    "stream_fanout": _OUTPUTS,
    "stream_followers": _OUTPUTS,
    "stream_backlog": f"SELECT *, true AS in_several_batches FROM ({_outputs(_ALL_WINDOWS)})",
}
