"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default
all cores), BENCH_RUNS (default 3 timed runs after one warm-up), BENCH_QUERIES
(comma-separated names, default the list below).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from riskflow.checks import all_queries

HEADLINE = [
    "daily_aggregates",
    "sliding_window_batch",
    "window_anomaly",
    "overview_operator",
    "overview_join",
    "alerts",
    "quarantine_reasons",
    "class_weight_rows",
    "auc_score",
    "event_sequence",
    "wire_roundtrip",
    "src_parquet_partitioned",
    "daily_job",
    "daily_incremental",
    "overview_pruned",
    "training_sample",
    "auc_bounds",
    "stream_open_windows",
    "sink_stream_partitioned",
    "sink_alerts",
    "stream_sliding_window",
    "stream_fanout",
    "stream_followers",
]
# Training dominates its own time; one timed run without a warm-up tells enough.
ONCE = ["ml_train_score", "stream_scoring"]


def timed(query, spark: SparkSession, sf_dir: str) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    names = names or HEADLINE + ONCE

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("riskflow-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else str(os.cpu_count()))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    seconds = {}
    for name in names:
        if name not in ONCE:
            timed(queries[name], spark, sf_dir)
        samples = [
            timed(queries[name], spark, sf_dir) for _ in range(1 if name in ONCE else runs)
        ]
        seconds[name] = round(statistics.median(samples), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median seconds over the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
