import pytest
from pyspark.sql import functions as F

from helpers import wire_rows
from riskflow import fixtures
from riskflow import schema as S
from riskflow.sinks import kafka_sink_options, write_kafka, write_scored
from riskflow.sources import kafka_options, read_history_csv, read_kafka, read_scored
from riskflow.operators import with_event_ts, with_risk_action


def _csv(spark, folder, columns):
    rows = wire_rows(spark, 20).select(*columns)
    rows.coalesce(1).write.option("header", True).csv(folder("csv"))
    return folder("csv")


def test_csv_with_schema(spark, folder):
    df = read_history_csv(spark, _csv(spark, folder, S.TRAIN.names))
    assert df.schema == S.TRAIN
    assert df.agg(F.sum("V9")).first()[0] == sum(range(20))


def test_csv_with_inferred_types(spark, folder):
    df = read_history_csv(spark, _csv(spark, folder, S.TRAIN.names), infer=True)
    assert dict(df.dtypes)["V1"] == "double" and dict(df.dtypes)["Class"] == "int"


def test_csv_with_columns_in_another_order_is_refused(spark, folder):
    path = _csv(spark, folder, ["Class", *S.TRAIN.names[:-1]])
    with pytest.raises(Exception, match="(?i)header"):
        read_history_csv(spark, path).collect()


def test_csv_accepts_quoted_numbers(spark, folder):
    header = ",".join(f'"{c}"' for c in S.TRAIN.names)
    line = ",".join(["1.5"] * 30 + ['"1"'])
    spark.createDataFrame([(header,), (line,)], "value string").coalesce(1).write.text(
        folder("csv")
    )
    row = read_history_csv(spark, folder("csv")).first()
    assert row["Class"] == 1 and row["V28"] == 1.5


def test_kafka_options():
    assert kafka_options("h:9092", "pay") == {
        "kafka.bootstrap.servers": "h:9092",
        "subscribe": "pay",
        "startingOffsets": "earliest",
    }
    bounded = kafka_options("h", "pay", "latest", max_offsets_per_trigger=10, min_partitions=64)
    assert bounded["startingOffsets"] == "latest"
    assert bounded["maxOffsetsPerTrigger"] == "10" and bounded["minPartitions"] == "64"
    secured = kafka_options("h", "pay", extra={"kafka.security.protocol": "SSL"})
    assert secured["kafka.security.protocol"] == "SSL" and secured["subscribe"] == "pay"
    assert kafka_sink_options("h", "pay") == {"kafka.bootstrap.servers": "h", "topic": "pay"}


def test_kafka_asks_for_its_connector(spark):
    """No connector is installed here, so Spark must name the missing source."""
    with pytest.raises(Exception, match="(?i)kafka"):
        read_kafka(spark, "h:9092", "pay")
    with pytest.raises(Exception, match="(?i)kafka"):
        write_kafka(spark.createDataFrame([("x",)], "value string"), "h:9092", "pay")


def test_scored_round_trip_recovers_the_tier(spark, folder):
    scored = with_risk_action(
        with_event_ts(wire_rows(spark, 10)).withColumn("Fraud_Probability", F.col("V1") / 10)
    )
    write_scored(scored, folder("scored"))
    back = read_scored(spark, folder("scored"))
    assert back.schema.names == S.SCORED.names
    tiers = {r["Risk_Action"]: r["count"] for r in back.groupBy("Risk_Action").count().collect()}
    assert tiers == {"ALLOW": 4, "TRIGGER_OTP": 3, "BLOCK_CARD": 3}


def test_fixture_counts(spark):
    tx = fixtures.tx(spark, "/root/testdata/sf0.01")
    rows = tx.groupBy("Risk_Action").agg(F.count("*").alias("n"), F.sum("Class").alias("f"))
    assert {r["Risk_Action"]: (r["n"], r["f"]) for r in rows.collect()} == {
        "ALLOW": (4000, 104),
        "TRIGGER_OTP": (3000, 75),
        "BLOCK_CARD": (3000, 86),
    }
