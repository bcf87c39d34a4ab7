"""Checks of training, saving, loading and scoring.

SQL cannot grow a forest. The twins check what must hold for every row: none
is lost, probabilities stay in range, and two ways to score agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow import fixtures, ml, plans
from riskflow import operators as ops
from riskflow import schema as S
from riskflow import streaming as st
from riskflow.checks import sql
from riskflow.session import scratch_dir
from riskflow.storage import remove_folder

AUC_FLOOR = 0.9

# A smaller forest where only the agreement of two scorings is checked.
SMALL_FOREST = {"trees": 20, "depth": 5}

# Of each class; at the smaller scales there are fewer frauds.
SAMPLE_ROWS = 500


def _small_model(spark: SparkSession, sf_dir: str):
    train, _ = ops.hash_split(fixtures.tx(spark, sf_dir), "event_id")
    return ml.train_model(ops.with_class_weight(train), **SMALL_FOREST)


def _unscored(tx: DataFrame) -> DataFrame:
    return tx.select("event_id", S.LABEL, *S.FEATURES)


def ml_train_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training job, then its model on the test part."""
    tx = fixtures.tx(spark, sf_dir)
    report = plans.run_training(spark, tx, scratch_dir(spark, "model"), key="event_id")
    _, test = ops.hash_split(_unscored(tx), "event_id")
    scored = ml.score(ml.load_model(report.model_path), test)
    return scored.select(
        "event_id",
        F.col("Fraud_Probability").between(0.0, 1.0).alias("in_range"),
        F.lit(report.test_auc >= AUC_FLOOR).alias("auc_above_floor"),
        F.lit(report.total_rows).cast("long").alias("total_rows"),
        F.lit(report.fraud_rows).cast("long").alias("fraud_rows"),
        F.round(
            F.when(F.col(S.LABEL) == 1, report.weight_fraud).otherwise(report.weight_non_fraud), 9
        ).alias("weight"),
    )


def ml_save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reloaded model scores every row as the fitted one does."""
    model, path = _small_model(spark, sf_dir), scratch_dir(spark, "model")
    ml.save_model(model, path)
    ml.save_model(model, path)
    rows = _unscored(fixtures.tx(spark, sf_dir))
    fitted = ml.score(model, rows).select(*rows.columns, F.col("Fraud_Probability").alias("p"))
    reloaded = ml.score(ml.load_model(path), fitted)
    same = F.col("p") == F.col("Fraud_Probability")
    return reloaded.select("event_id", same.alias("same_score"))


def stream_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream gets the scores and tiers a batch gets."""
    model, root = _small_model(spark, sf_dir), scratch_dir(spark, "stream")

    def scored(tx: DataFrame) -> DataFrame:
        rows = ops.with_risk_action(ml.score(model, _unscored(tx)))
        return rows.select("event_id", "Fraud_Probability", "Risk_Action")

    stream = scored(fixtures.tx_from_events(fixtures.events_stream(spark, sf_dir)))
    st.await_each(
        [st.write_parquet_stream(stream, f"{root}/out", f"{root}/check", st.RUN_TO_COMPLETION)]
    )
    batch = scored(fixtures.tx(spark, sf_dir)).withColumnsRenamed(
        {"Fraud_Probability": "p", "Risk_Action": "tier"}
    )
    streamed = spark.read.parquet(f"{root}/out")
    return streamed.join(batch, "event_id", "left").select(
        "event_id",
        F.col("p").eqNullSafe(F.col("Fraud_Probability")).alias("same_score"),
        F.col("tier").eqNullSafe(F.col("Risk_Action")).alias("same_tier"),
    )


def training_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a bounded forest would grow from."""
    train, _ = ops.hash_split(fixtures.tx(spark, sf_dir), "event_id")
    sample = ops.stratified_sample(train, SAMPLE_ROWS, "event_id")
    return sample.select("event_id", S.LABEL)


def auc_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the area from histograms, beside the area by sorting."""
    scored = fixtures.tx(spark, sf_dir).select("Fraud_Probability", S.LABEL)
    coarse = ml.auc_bounds(scored, within=1.0)
    fine = ml.auc_bounds(scored, within=1e-9)
    exact = ml.auc(scored, score="Fraud_Probability")
    found = (
        F.lit(coarse.lower - 1e-12 <= exact <= coarse.upper + 1e-12).alias("coarse_holds"),
        F.lit(fine.lower - 1e-12 <= exact <= fine.upper + 1e-12).alias("fine_holds"),
        F.round(F.lit(fine.lower), 6).alias("lower"),
        F.round(F.lit(fine.upper), 6).alias("upper"),
    )
    return scored.groupBy().agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", *found)


def ml_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the current model after a save that broke off, and of the one before."""
    path, rows = scratch_dir(spark, "model"), _unscored(fixtures.tx(spark, sf_dir))
    train, _ = ops.hash_split(fixtures.tx(spark, sf_dir), "event_id")
    weighted = ops.with_class_weight(train)
    models = [ml.train_model(weighted, trees=n, depth=4) for n in (5, 10)]
    first, second = [ml.save_model(model, path) for model in models]
    # What a save leaves that did not get as far as its stages.
    models[0].write().save(f"{path}/versions/v999999-0")
    remove_folder(spark, f"{path}/versions/v999999-0/stages")
    found = rows
    for name, model in (
        ("fitted_1", models[0]),
        ("stored_1", ml.load_model(path, first)),
        ("fitted_2", models[1]),
        ("stored_2", ml.load_model(path)),
    ):
        scored = ml.score(model, found)
        found = scored.select(*found.columns, F.col("Fraud_Probability").alias(name))
    whole = ml.model_versions(spark, path) == [first, second]
    return found.select(
        "event_id",
        (F.col("fitted_1") == F.col("stored_1")).alias("same_former"),
        (F.col("fitted_2") == F.col("stored_2")).alias("same_current"),
        F.lit(whole and ml.current_version(spark, path) == second).alias("names_right"),
    )


QUERIES = {
    "ml_train_score": ml_train_score,
    "ml_save_load": ml_save_load,
    "stream_scoring": stream_scoring,
    "training_sample": training_sample,
    "auc_bounds": auc_bounds,
    "ml_versions": ml_versions,
}

SQL = {
    "ml_train_score": sql.tx()
    + """, counted AS (
  SELECT CAST(count(*) AS BIGINT) AS total_rows,
    CAST(count(*) FILTER ("Class" = 1) AS BIGINT) AS fraud_rows FROM tx)
SELECT event_id, true AS in_range, true AS auc_above_floor, total_rows, fraud_rows,
  round(CASE WHEN "Class" = 1 THEN total_rows / fraud_rows
    ELSE total_rows / (total_rows - fraud_rows) END, 9) AS weight
FROM tx, counted
WHERE ((event_id % 2147483648) * 2654435761) % 4294967296 >= 0.8 * 4294967296""",
    "ml_save_load": "SELECT event_id, true AS same_score FROM events",
    "training_sample": sql.tx()
    + f""", keyed AS (
  SELECT event_id, "Class", ((event_id % 2147483648) * 2654435761) % 4294967296 AS hash FROM tx)
SELECT event_id, "Class" FROM keyed WHERE hash < 0.8 * 4294967296
QUALIFY row_number() OVER (PARTITION BY "Class" = 1 ORDER BY hash, event_id) <= {SAMPLE_ROWS}""",
    # Every pair of a fraud and another row, counted below each fraud's score.
    "auc_bounds": sql.tx()
    + """, ranked AS (
  SELECT "Class", rank() OVER (ORDER BY "Fraud_Probability") AS low,
    count(*) OVER (PARTITION BY "Fraud_Probability") AS same FROM tx),
area AS (
  SELECT (sum(low + (same - 1) / 2) FILTER ("Class" = 1)
      - count(*) FILTER ("Class" = 1) * (count(*) FILTER ("Class" = 1) + 1) / 2)
    / (count(*) FILTER ("Class" = 1) * count(*) FILTER ("Class" <> 1)) AS value,
    count(*) AS n_rows FROM ranked)
SELECT CAST(n_rows AS BIGINT) AS n_rows, true AS coarse_holds, true AS fine_holds,
  round(value, 6) AS lower, round(value, 6) AS upper FROM area""",
    "ml_versions": """SELECT event_id, true AS same_former, true AS same_current,
  true AS names_right FROM events""",
    "stream_scoring": "SELECT event_id, true AS same_score, true AS same_tier FROM events",
}
