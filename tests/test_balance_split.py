import pytest
from pyspark.sql import functions as F

from riskflow.operators import class_balance, class_weights, hash_split, with_class_weight


def _labels(spark, total, frauds):
    return spark.range(total).select("id", (F.col("id") < frauds).cast("int").alias("Class"))


def test_balance_counts_null_as_non_fraud(spark):
    df = spark.createDataFrame([(1,), (1,), (0,), (None,)], "Class int")
    assert tuple(class_balance(df).first()) == (4, 2, 2)


def test_weights(spark):
    row = class_weights(_labels(spark, 10_000, 265)).first()
    assert row["weight_fraud"] == 37.735849056603776
    assert row["weight_non_fraud"] == 1.027221366204417


@pytest.mark.parametrize("given", [False, True])
def test_each_class_weighs_as_much_as_all_rows(spark, given):
    df = _labels(spark, 1000, 37)
    weights = class_weights(df).first() if given else None
    weighted = with_class_weight(df, weights=weights)
    sums = [r["w"] for r in weighted.groupBy("Class").agg(F.sum("weight").alias("w")).collect()]
    assert sums == pytest.approx([1000.0, 1000.0])


@pytest.mark.parametrize(("frauds", "missing"), [(0, "no fraud rows"), (20, "no non-fraud rows")])
def test_a_missing_class_is_named(spark, frauds, missing):
    with pytest.raises(Exception, match=missing):
        class_weights(_labels(spark, 20, frauds)).collect()


def test_weights_take_one_aggregate_of_the_table(spark):
    plan = with_class_weight(_labels(spark, 100, 5))._jdf.queryExecution().optimizedPlan()
    assert "Join" not in plan.toString()


def test_split_ignores_partitioning(spark):
    df = spark.range(20_000)
    train, test = hash_split(df, "id")
    again, _ = hash_split(df.repartition(3), "id")
    ids = {r["id"] for r in train.collect()}
    assert ids == {r["id"] for r in again.collect()}
    assert train.count() + test.count() == 20_000
    assert abs(len(ids) / 20_000 - 0.8) < 0.01


def test_split_by_whole_row_keeps_copies_together_and_loses_none(spark):
    df = spark.range(4000).select((F.col("id") % 1000).alias("a"), F.lit("x").alias("b"))
    train, test = hash_split(df)
    assert train.count() + test.count() == 4000
    assert train.join(test, ["a", "b"], "left_semi").count() == 0
    assert abs(train.count() / 4000 - 0.8) < 0.06


def test_split_of_negative_and_null_keys(spark):
    df = spark.createDataFrame([(-1,), (-5,), (None,), (2**40,)], "k long")
    train, test = hash_split(df, "k")
    assert train.count() + test.count() == 4
