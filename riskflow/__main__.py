"""Run a job: ``python -m riskflow <job> --help``.

On a cluster: ``spark-submit --py-files riskflow.zip riskflow/__main__.py <job> …``.
"""

from __future__ import annotations

import argparse
import datetime as dt
from dataclasses import asdict

from pyspark.sql import SparkSession

from riskflow import plans, sinks, sources, streaming
from riskflow import schema as S
from riskflow.session import build_session, use_rocksdb_state


def _train(spark: SparkSession, args: argparse.Namespace) -> None:
    report = plans.run_training(
        spark,
        args.history,
        args.model,
        key=args.key,
        partitions=args.partitions,
        rows_per_class=args.rows_per_class,
    )
    for name, value in asdict(report).items():
        print(f"{name}: {value}")


def _replay(spark: SparkSession, args: argparse.Namespace) -> None:
    plans.run_replay(
        spark,
        args.history,
        args.key.split(","),
        args.start,
        frauds=args.frauds,
        path=args.path,
        servers=args.servers,
        topic=args.topic,
    )


def _stream(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.rocksdb:
        use_rocksdb_state(spark)
    if args.path is not None:
        messages = sources.read_envelope_files(
            spark, args.path, numbered=args.hbase_host is not None, suffix=args.suffix
        )
    else:
        messages = sources.read_kafka(
            spark, args.servers, args.topic, max_offsets_per_trigger=args.max_offsets
        )
    trigger = (
        streaming.RUN_TO_COMPLETION if args.once else {"processingTime": args.trigger}
    )
    running = plans.run_stream(
        spark,
        messages,
        args.model,
        streaming.StreamPaths(args.output),
        trigger,
        follow=args.follow,
        alert_store=sinks.hbase_store(args.hbase_host, args.hbase_table)
        if args.hbase_host
        else None,
        max_bytes=args.max_bytes,
        retention=args.retention,
    )
    if args.once:
        streaming.await_each(running.values())
    else:
        streaming.await_any(spark)


def _daily(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.checkpoint is not None:
        plans.run_daily_incremental(
            spark, args.scored, args.daily, args.checkpoint, args.table
        ).awaitTermination()
        return
    plans.run_daily(
        spark,
        args.scored,
        args.daily,
        table=args.table,
        since=args.since,
        repair=args.repair,
    )


def _late(spark: SparkSession, args: argparse.Namespace) -> None:
    paths = streaming.StreamPaths(args.output)
    read = streaming.stored_files(spark, paths.scored)
    batch = streaming.collect_late(spark, paths.checkpoint("windows"), read, paths.late)
    print(f"collected up to batch {batch}")


def _publish(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.checkpoint is None:
        sinks.copy_scored(spark, args.sink, args.scored, by_day=args.by_day)
    else:
        streaming.publish_scored(
            spark, args.sink, args.scored, args.checkpoint, args.by_day
        ).awaitTermination()


def _setup(spark: SparkSession, args: argparse.Namespace) -> None:
    plans.setup_catalog(spark, args.scored, args.daily)


def _repair(spark: SparkSession, args: argparse.Namespace) -> None:
    for table in args.tables:
        sources.repair_partitions(spark, table)


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="riskflow", description=__doc__.splitlines()[0])
    parser.add_argument("--hive", action="store_true", help="use the Hive metastore")
    jobs = parser.add_subparsers(dest="job", required=True)

    train = jobs.add_parser("train", help="fit, evaluate and save the model")
    train.add_argument("--history", required=True, help="labelled CSV with a header")
    train.add_argument("--model", required=True)
    train.add_argument("--key", help="integer column that identifies a row; default the whole row")
    train.add_argument("--partitions", type=int, help="tasks that hold the training rows")
    train.add_argument("--rows-per-class", type=int, help="rows of each class to learn from at most")
    train.set_defaults(run=_train)

    replay = jobs.add_parser("replay", help="turn labelled history into messages")
    replay.add_argument("--history", required=True, help="labelled CSV with a header")
    replay.add_argument("--key", required=True, help="columns that identify a row, by commas")
    replay.add_argument("--start", type=dt.datetime.fromisoformat, required=True)
    replay.add_argument("--frauds", type=int, help="send so many frauds only; default all")
    replay.add_argument("--path", help="folder for message files")
    replay.add_argument("--servers")
    replay.add_argument("--topic")
    replay.set_defaults(run=_replay)

    stream = jobs.add_parser("stream", help="score messages into tables, alerts and windows")
    stream.add_argument("--model", required=True)
    stream.add_argument("--output", required=True, help="root of outputs and checkpoints")
    source = stream.add_mutually_exclusive_group(required=True)
    source.add_argument("--path", help="folder of message files")
    source.add_argument("--topic")
    stream.add_argument("--servers")
    stream.add_argument("--max-offsets", type=int, help="bound on messages per micro-batch")
    stream.add_argument("--max-bytes", type=int, help="bound on a follower's micro-batch")
    stream.add_argument("--retention", help="age, such as 14d, at which the sink's log forgets files")
    stream.add_argument("--trigger", default=S.TRIGGER_INTERVAL)
    stream.add_argument("--once", action="store_true", help="process what is there, then stop")
    stream.add_argument(
        "--follow",
        action=argparse.BooleanOptionalAction,
        default=True,
        help="score once and let the other outputs follow; see the README",
    )
    stream.add_argument("--rocksdb", action="store_true", help="keep window state in RocksDB")
    stream.add_argument("--hbase-host", help="put alerts into HBase instead of Parquet")
    stream.add_argument("--hbase-table", default=S.ALERT_TABLE)
    stream.add_argument(
        "--suffix", default=".txt", help="how message files end that HBase alerts come from"
    )
    stream.set_defaults(run=_stream)

    daily = jobs.add_parser("daily", help="write daily totals and repair their table")
    daily.add_argument("--scored", required=True)
    daily.add_argument("--daily", required=True)
    daily.add_argument("--table", default=S.DAILY_TABLE)
    daily.add_argument(
        "--checkpoint", help="count only what is new since the last run with it, and merge"
    )
    daily.add_argument("--since", type=dt.date.fromisoformat, help="first UTC day to recompute")
    daily.add_argument("--repair", nargs="*", default=[], help="further tables to repair")
    daily.set_defaults(run=_daily)

    late = jobs.add_parser("late", help="collect rows that came too late for their windows")
    late.add_argument("--output", required=True, help="root of the stream job")
    late.set_defaults(run=_late)

    publish = jobs.add_parser("publish", help="copy a scored sink to a table folder")
    publish.add_argument("--sink", required=True)
    publish.add_argument("--scored", required=True)
    publish.add_argument("--checkpoint", help="add only what is new since the last run with it")
    publish.add_argument("--by-day", action="store_true", help="a folder per day below the tier")
    publish.set_defaults(run=_publish)

    setup = jobs.add_parser("setup", help="declare both tables and the overview view")
    setup.add_argument("--scored", required=True)
    setup.add_argument("--daily", required=True)
    setup.set_defaults(run=_setup)

    repair = jobs.add_parser("repair", help="repair the partitions of tables")
    repair.add_argument("tables", nargs="*", default=[S.SCORED_TABLE, S.DAILY_TABLE])
    repair.set_defaults(run=_repair)
    return parser


def main(argv: list[str] | None = None) -> None:
    args = build_parser().parse_args(argv)
    settings = {"spark.sql.catalogImplementation": "hive"} if args.hive else {}
    spark = build_session(f"riskflow-{args.job}", settings)
    args.run(spark, args)


if __name__ == "__main__":
    main()
