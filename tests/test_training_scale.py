import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.util import JavaMLWriter
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from helpers import physical_plan
from riskflow import fixtures, ml
from riskflow import schema as S
from riskflow.functions import split_hash
from riskflow.ml import area
from riskflow.operators import stratified_sample
from riskflow.plans import TRAINING_TASKS, run_training, training
from riskflow.storage import child_names, read_small, remove_folder, replace_small

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def history(spark):
    return fixtures.tx(spark, DATA).cache()


def _fit(history, trees):
    weighted = history.withColumn("weight", F.lit(1.0))
    return ml.train_model(weighted, trees=trees, depth=2)


# Versions


def test_saving_again_keeps_the_former_versions(spark, history, folder):
    path = folder("model")
    names = [ml.save_model(_fit(history, n), path, keep=1) for n in (1, 2, 3)]
    assert ml.current_version(spark, path) == names[2]
    assert ml.model_versions(spark, path) == names[1:]
    assert ml.load_model(path).stages[-1].getNumTrees == 3
    assert ml.load_model(path, names[1]).stages[-1].getNumTrees == 2
    ml.use_version(path, names[1])
    assert ml.load_model(path).stages[-1].getNumTrees == 2
    with pytest.raises(ValueError, match="no version"):
        ml.use_version(path, names[0])


@pytest.mark.parametrize("step", ["write", "point"])
def test_a_save_that_breaks_off_leaves_the_old_model(spark, history, folder, monkeypatch, step):
    path = folder("model")
    first = ml.save_model(_fit(history, 1), path)
    model = _fit(history, 2)
    if step == "point":
        monkeypatch.setattr(ml.versions, "replace_small", _fail)
    else:
        monkeypatch.setattr(type(model), "write", lambda self: _HalfWriter(self))
    with pytest.raises(RuntimeError, match="broken off"):
        ml.save_model(model, path)
    monkeypatch.undo()
    assert ml.current_version(spark, path) == first
    assert ml.model_versions(spark, path)[0] == first
    assert len(ml.model_versions(spark, path)) == (2 if step == "point" else 1)
    assert ml.load_model(path).stages[-1].getNumTrees == 1
    assert ml.save_model(model, path) != first
    assert ml.load_model(path).stages[-1].getNumTrees == 2


def _fail(*args, **options):
    raise RuntimeError("broken off")


class _HalfWriter:
    """Writes a model as far as its metadata."""

    def __init__(self, model):
        self.writer = JavaMLWriter(model)

    def save(self, path):
        self.writer.save(path)
        remove_folder(SparkSession.active(), f"{path}/stages")
        _fail()


def test_a_model_without_versions_is_read_too(spark, history, folder):
    _fit(history, 2).write().save(folder("old"))
    assert ml.load_model(folder("old")).stages[-1].getNumTrees == 2
    ml.save_model(_fit(history, 3), folder("old"))
    assert ml.load_model(folder("old")).stages[-1].getNumTrees == 3


def test_the_pointer_is_replaced_whole(spark, folder):
    path = folder("note")
    for text in ("one", "another", ""):
        replace_small(spark, path, text)
        assert read_small(spark, path) == text
    left = [n for n in child_names(spark, folder("")) if n.startswith("note.")]
    assert left == []


# Sample


def _plain_sample(rows, k):
    """Of (key, class) rows the k with the least hashes of each class."""
    found = []
    for kind in (True, False):
        mine = [(key % 2**31 * 2654435761 % 2**32, key) for key, y in rows if key is not None and (y == 1) == kind]
        found += [key for _, key in sorted(mine)[:k]]
    return sorted(found)


@pytest.mark.parametrize("k", [0, 1, 7, 40, 1000])
def test_the_sample_is_the_least_hashes_of_each_class(spark, k):
    choose = random.Random(k)
    rows = [(choose.randrange(-(2**40), 2**40), choose.choice([0, 0, 0, 1, None])) for _ in range(300)]
    rows += [(None, 1), (None, 0), (5, 1), (5, 1), (5 + 2**31, 1), (5 + 2**32, 0)]
    df = spark.createDataFrame(rows, "k long, Class int").repartition(3)
    got = stratified_sample(df, k, "k")
    assert got.columns == df.columns
    assert sorted(r["k"] for r in got.collect()) == _plain_sample(rows, k)


def test_equal_keys_are_cut_by_content(spark):
    rows = [(7, 1, float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, Class int, v double")
    first = sorted(stratified_sample(df.repartition(4), 20, "k").collect())
    assert len(first) == 20
    assert first == sorted(stratified_sample(df.coalesce(1), 20, "k").collect())


def test_a_sample_without_a_key(spark, history):
    rows = history.select("Amount", "Class", "V1")
    got = stratified_sample(rows, 30)
    assert {(r["Class"], r["n"]) for r in got.groupBy("Class").agg(F.count("*").alias("n")).collect()} == {
        (0, 30),
        (1, 23),
    }


def test_rows_are_filtered_not_moved(spark, folder, history):
    history.write.parquet(folder("rows"))
    sample = stratified_sample(spark.read.parquet(folder("rows")), 100, "event_id")
    plan = physical_plan(sample)
    # Only the rows at the very bound are ordered, by a top-k.
    assert "Sort " not in plan and "Window" not in plan and "ShuffledHash" not in plan
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_training_on_a_bounded_sample(spark, history, folder):
    whole = run_training(spark, history, folder("a"), key="event_id", trees=5, depth=3)
    part = run_training(
        spark, history, folder("b"), key="event_id", rows_per_class=100, trees=5, depth=3
    )
    train = history.filter(split_hash("event_id") < 0.8 * 2**32)
    frauds = train.filter("Class = 1").count()
    assert whole.training_rows == train.count()
    assert part.training_rows == 100 + frauds
    assert (part.weight_fraud, part.total_rows) == (whole.weight_fraud, 1000)
    assert part.test_auc > 0.8


def test_each_class_keeps_its_weight_in_the_sample(spark, history, folder, monkeypatch):
    sums, fit = [], training.train_model

    def weigh(rows, **options):
        totals = rows.groupBy("Class").agg(F.sum("weight").alias("w")).collect()
        sums.append({r["Class"]: round(r["w"], 6) for r in totals})
        return fit(rows, **options)

    monkeypatch.setattr(training, "train_model", weigh)
    for rows in (None, 10):
        run_training(
            spark, history, folder(f"m{rows}"), key="event_id", rows_per_class=rows, trees=1, depth=1
        )
    assert sums[0] == sums[1]


def test_tasks_follow_the_rows(spark, history, folder, monkeypatch):
    def tasks(**options):
        return run_training(
            spark, history, folder(str(len(options))), key="event_id", trees=1, depth=1, **options
        ).training_tasks

    assert tasks() == TRAINING_TASKS
    monkeypatch.setattr(training, "ROWS_PER_TASK", 10)
    assert tasks() == 80
    assert TRAINING_TASKS < tasks(rows_per_class=150) < 20


def test_rows_are_assembled_once_and_the_forest_is_the_same(spark, history, monkeypatch):
    rows = history.withColumn("weight", F.lit(1.0)).repartition(4, "event_id")
    rows = rows.sortWithinPartitions("event_id").select(*S.FEATURES, "Class", "weight")
    plain = RandomForestClassifier(
        labelCol="Class", weightCol="weight", numTrees=7, maxDepth=6, seed=ml.forest.SEED
    )
    expected = Pipeline(stages=[ml.feature_stage(), plain]).fit(rows).stages[-1]
    seen, fit = [], RandomForestClassifier.fit

    def watch(forest, dataset):
        seen.append((forest.getCacheNodeIds(), dataset.storageLevel, dataset))
        return fit(forest, dataset)

    monkeypatch.setattr(RandomForestClassifier, "fit", watch)
    model = ml.train_model(rows, trees=7, depth=6)
    trees = lambda forest: forest.toDebugString.split("\n", 1)[1]
    assert trees(model.stages[-1]) == trees(expected)
    (kept, level, dataset), = seen
    assert kept and level.useDisk and not level.useMemory
    # Nothing is left behind.
    assert not dataset.storageLevel.useDisk


# Area


def _plain_area(rows):
    fraud = [p for p, y in rows if y == 1]
    others = [p for p, y in rows if y != 1]
    if not fraud or not others:
        return None
    won = sum((a > b) + (a == b) / 2 for a in fraud for b in others)
    return won / (len(fraud) * len(others))


@settings(max_examples=15, deadline=None)
@given(
    some.lists(
        some.tuples(some.sampled_from([0.0, 0.1, 0.1000001, 0.5, 0.9, 1.0, -3.0, 1e12, 1e-300]), some.sampled_from([0, 1, 1, None])),
        min_size=1,
        max_size=40,
    )
)
def test_bounds_hold_for_any_scores(spark, rows):
    df = spark.createDataFrame(rows, "p double, Class int")
    exact = _plain_area(rows)
    for within, passes in ((1.0, 1), (0.0, 3)):
        found = ml.auc_bounds(df, "p", within=within, passes=passes)
        if exact is None:
            assert found.lower != found.lower
        else:
            assert found.lower - 1e-9 <= exact <= found.upper + 1e-9


def test_further_passes_narrow_the_bounds(spark, monkeypatch):
    choose = random.Random(3)
    rows = [(choose.betavariate(1, 30) + 0.2 * y, y) for y in (0, 1) for _ in range(1500)]
    df = spark.createDataFrame(rows, "p double, Class int")
    monkeypatch.setattr(area, "CELLS", 8)
    monkeypatch.setattr(area, "PARTS", 16)
    found = [ml.auc_bounds(df, "p", within=0.0, passes=n) for n in (1, 2, 3, 4, 5)]
    widths = [a.upper - a.lower for a in found]
    assert widths == sorted(widths, reverse=True) and widths[0] > 1e-3 and widths[4] < 1e-6
    exact = _plain_area(rows)
    assert all(a.lower - 1e-9 <= exact <= a.upper + 1e-9 for a in found)
    monkeypatch.setattr(area, "REFINED", 1)
    few = ml.auc_bounds(df, "p", within=0.0, passes=4)
    assert few.lower - 1e-9 <= exact <= few.upper + 1e-9


def test_odd_scores_take_no_part(spark):
    rows = [(0.9, 1), (0.1, 0), (None, 1), (float("nan"), 0), (float("inf"), 1), (float("-inf"), 0)]
    df = spark.createDataFrame(rows, "p double, Class int")
    found = ml.auc_bounds(df, "p")
    assert (found.lower, found.upper) == (1.0, 1.0)
    assert ml.auc_bounds(df.limit(0), "p").lower != 0


def test_no_pass_sorts_the_scores(spark, history, monkeypatch):
    plans = []
    cells = area._cells
    monkeypatch.setattr(area, "_cells", lambda placed, keys: plans.append(physical_plan(placed.groupBy(*keys).count())) or cells(placed, keys))
    monkeypatch.setattr(area, "CELLS", 4)
    ml.auc_bounds(history, within=0.0)
    assert len(plans) == 3
    assert not any("Sort" in plan or "SortMergeJoin" in plan for plan in plans)
