from __future__ import annotations

import datetime as dt

from riskflow import schema as S


def utc(text: str) -> dt.datetime:
    """Naive UTC time, as collected rows hold it."""
    return dt.datetime.fromisoformat(text)


def transactions(spark, rows):
    """Rows of (event time text or null, Amount, Class) with a parsed event_ts."""
    from riskflow.functions import parse_event_time

    df = spark.createDataFrame(rows, "eventTime string, Amount double, Class int")
    return df.withColumn("event_ts", parse_event_time("eventTime"))


def wire_rows(spark, n, **overrides):
    """``n`` complete wire rows; an override maps the row number to a value."""

    def value(field, i):
        if field.name in overrides:
            return overrides[field.name](i)
        if field.name == "eventTime":
            return f"2025-01-01T00:{i % 60:02d}:00.000000Z"
        if field.name == "Class":
            return i % 2
        return float(i)

    rows = [tuple(value(f, i) for f in S.WIRE.fields) for i in range(n)]
    return spark.createDataFrame(rows, S.WIRE)


def physical_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted_plan(df) -> str:
    jvm = df.sparkSession._jvm
    mode = jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)
