import json
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpers import wire_rows
from riskflow import fixtures
from riskflow import schema as S
from riskflow.operators import parse_wire, split_valid, to_envelope, with_event_ts
from riskflow.operators.wire import CORRUPT, REASON

SMALL = T.StructType(
    [T.StructField("Amount", T.DoubleType()), T.StructField("Class", T.IntegerType())]
)


@pytest.mark.parametrize(
    ("text", "amount", "label"),
    [
        ('{"Class":1.0,"Amount":1}', 1.0, None),
        ('{"Amount":"5.5","Class":"1"}', None, None),
        ("{broken", None, None),
        ("", None, None),
        (None, None, None),
        ('[{"Amount":1.0,"Class":1}]', None, None),
        ('{"amount":3}', None, None),
        ('{"Amount":2.5,"Class":1,"extra":[1]}', 2.5, 1),
    ],
)
def test_permissive_parse(spark, text, amount, label):
    df = spark.createDataFrame([(text,)], "value string")
    row = parse_wire(df, SMALL).first()
    assert (row["Amount"], row["Class"]) == (amount, label)


def test_nan_literal_is_a_number(spark):
    df = spark.createDataFrame([('{"Amount":NaN,"Class":0}',)], "value string")
    row = parse_wire(df, SMALL).first()
    assert math.isnan(row["Amount"]) and row["Class"] == 0


@pytest.mark.parametrize(
    ("text", "amount", "corrupt"),
    [
        ('{"Amount":1.5}', 1.5, None),
        ("{bad", None, "{bad"),
        ('{"Amount":"x"}', None, '{"Amount":"x"}'),
    ],
)
def test_corrupt_column(spark, text, amount, corrupt):
    df = spark.createDataFrame([(text,)], "value string")
    row = parse_wire(df, SMALL, corrupt=CORRUPT).first()
    assert (row["Amount"], row[CORRUPT]) == (amount, corrupt)


def test_binary_payload_and_kept_columns(spark):
    df = spark.createDataFrame([(5, bytearray(b'{"Amount":1}'))], "offset long, value binary")
    row = parse_wire(df, SMALL, keep=["offset"]).first()
    assert (row["offset"], row["Amount"]) == (5, 1.0)


def test_envelope_round_trip_is_exact(spark):
    values = {"Amount": lambda i: i / 7, "V3": lambda i: 1e-9 * i, "Class": lambda i: i % 3}
    rows = wire_rows(spark, 50, **values)
    back = parse_wire(to_envelope(rows))
    assert back.schema.names == S.WIRE.names
    assert sorted(back.collect()) == sorted(rows.collect())


def test_envelope_label_is_an_integer(spark):
    rows = wire_rows(spark, 2).withColumn("Class", F.lit(1.0))
    payload = json.loads(to_envelope(rows).first()["value"])
    assert payload["Class"] == 1 and isinstance(payload["Class"], int)


def test_split_keeps_every_row_and_names_the_first_fault(spark):
    good = wire_rows(spark, 4)
    messages = to_envelope(good).unionByName(
        spark.createDataFrame(
            [
                ("{broken",),
                ('{"Class":1.0}',),
                ("{}",),
                ("",),
                (None,),
            ],
            "value string",
        )
    )
    no_time = to_envelope(wire_rows(spark, 1, eventTime=lambda i: "garbage"))
    no_label = to_envelope(wire_rows(spark, 1, Class=lambda i: None))
    nan = to_envelope(wire_rows(spark, 1)).selectExpr(
        """regexp_replace(value, '"V7":0.0', '"V7":NaN') AS value"""
    )
    everything = messages.unionByName(no_time).unionByName(no_label).unionByName(nan)
    valid, rejected = split_valid(with_event_ts(parse_wire(everything, corrupt=CORRUPT)))
    assert sorted(r[REASON] for r in rejected.collect()) == ["bad_feature"] * 4 + ["bad_json"] * 2
    assert sorted(str(r[REASON]) for r in valid.collect()) == ["None"] * 5 + ["bad_event_time"]
    assert valid.count() + rejected.count() == everything.count()


def test_quarantine_counts_on_the_fixture(spark):
    messages = fixtures.messages(spark, "/root/testdata/sf0.01", dirty=True, broken=True)
    valid, rejected = split_valid(with_event_ts(parse_wire(messages, corrupt=CORRUPT)))
    counts = {r[REASON]: r["count"] for r in rejected.groupBy(REASON).count().collect()}
    labels = {r[REASON]: r["count"] for r in valid.groupBy(REASON).count().collect()}
    assert counts == {"bad_json": 20, "bad_feature": 40}
    assert labels == {"bad_event_time": 20, None: 9920}
