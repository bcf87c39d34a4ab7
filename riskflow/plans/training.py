"""Train, evaluate and save the model."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow import schema as S
from riskflow.ml import auc, auc_bounds, save_model, score, train_model
from riskflow.operators.balance import class_balance, class_weights, with_class_weight
from riskflow.operators.sample import stratified_sample
from riskflow.operators.split import hash_split
from riskflow.session import scratch_dir
from riskflow.sources.history import read_history_csv
from riskflow.storage import remove_folder


#: Tasks that hold the training rows unless told otherwise: so many at least, and more
#: where each would hold more rows than that.
TRAINING_TASKS = 16
ROWS_PER_TASK = 250_000


@dataclass(frozen=True)
class TrainingReport:
    total_rows: int
    fraud_rows: int
    non_fraud_rows: int
    weight_fraud: float
    weight_non_fraud: float
    fit_seconds: float
    test_auc: float
    model_path: str
    training_rows: int
    training_tasks: int


def run_training(
    spark: SparkSession,
    history: str | DataFrame,
    model_path: str,
    key: str | None = None,
    train: float = 0.8,
    weights_from_train: bool = False,
    partitions: int | None = None,
    auc_bins: int | None = None,
    auc_within: float = 1e-6,
    rows_per_class: int | None = None,
    **forest_params,
) -> TrainingReport:
    """Fit the weighted forest, measure it on the held-out part and save it.

    ``history`` is a CSV path or a DataFrame. It is computed once, into Parquet in
    the shared scratch folder, since weights, split candidates, bagging and
    evaluation each scan the data. Weights come from the whole history unless
    ``weights_from_train``.

    ``rows_per_class`` bounds the rows that the forest grows from: of each class those
    with the least hashes of their key. Each class still weighs as much in the sample as
    it does in all rows, so a class of which fewer rows were taken weighs more per row.

    Bagging draws at random per task. So that the same rows give the same forest
    whatever files, cores or executors they come from, they are dealt to a number of
    tasks that follows from their own number, by ``key``, or by their content without
    one, and sorted there. ``partitions`` sets that number; another one is another forest.

    The area is the middle of two bounds that are ``auc_within`` apart, from histograms
    of the scores. ``auc_bins`` asks for Spark's own instead, from so many thresholds; 0
    takes every distinct score, which sorts them all.
    """
    if isinstance(history, str):
        history = read_history_csv(spark, history)
    scratch = [scratch_dir(spark, "history")]
    history.write.parquet(scratch[0])
    history = spark.read.schema(history.schema).parquet(scratch[0])
    train_rows, test_rows = hash_split(history, key, train)
    weights = class_weights(train_rows if weights_from_train else history).first()
    row_weights, training_rows = weights.asDict(), None
    if rows_per_class is not None:
        before = class_balance(train_rows).first()
        sampled = stratified_sample(train_rows, rows_per_class, key)
        # Read by every pass of the forest: a bounded number of rows.
        scratch.append(scratch_dir(spark, "training-sample"))
        sampled.write.parquet(scratch[-1])
        train_rows = spark.read.schema(history.schema).parquet(scratch[-1])
        taken = class_balance(train_rows).first()
        training_rows = taken["total_rows"]
        for kind in ("fraud", "non_fraud"):
            if taken[f"{kind}_rows"]:
                share = before[f"{kind}_rows"] / taken[f"{kind}_rows"]
                row_weights[f"weight_{kind}"] *= share
    if training_rows is None:
        training_rows = train_rows.count()
    if partitions is None:
        partitions = max(TRAINING_TASKS, -(-training_rows // ROWS_PER_TASK))

    started = time.monotonic()
    weighted = with_class_weight(train_rows, weights=row_weights)
    content = F.xxhash64(*[F.col(c) for c in train_rows.columns])
    place = [F.col(key), content] if key is not None else [content]
    weighted = weighted.repartition(partitions, place[0]).sortWithinPartitions(*place)
    model = train_model(weighted.select(*S.FEATURES, S.LABEL, "weight"), **forest_params)
    fit_seconds = time.monotonic() - started

    tested = score(model, test_rows)
    if auc_bins is None:
        # Several passes over the scores, one over the forest.
        scratch.append(scratch_dir(spark, "test-scores"))
        tested.select("Fraud_Probability", S.LABEL).write.parquet(scratch[-1])
        test_auc = auc_bounds(spark.read.parquet(scratch[-1]), within=auc_within).middle
    else:
        test_auc = auc(tested, bins=auc_bins)
    save_model(model, model_path)
    for folder in scratch:
        remove_folder(spark, folder)
    return TrainingReport(
        **weights.asDict(),
        fit_seconds=fit_seconds,
        test_auc=test_auc,
        model_path=model_path,
        training_rows=training_rows,
        training_tasks=partitions,
    )
