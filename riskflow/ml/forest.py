"""Class-weighted random forest over the transaction features."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame

from riskflow import schema as S
from riskflow.functions import fraud_probability

# The settings under which existing models were trained.
TREES = 100
DEPTH = 10
SEED = 42
FEATURE_SUBSET = "auto"

#: How a pass finds the node of each row in each tree: it is kept, not looked for from the
#: root again. The forest is the same.
PASSES = {"cacheNodeIds": True, "checkpointInterval": -1}


def feature_stage() -> VectorAssembler:
    """The features in their contract order; null or NaN is an error here.

    It exists only inside the pipeline, so callers pass raw columns to the
    model and never assemble features themselves.
    """
    return VectorAssembler(inputCols=S.FEATURES, outputCol="features", handleInvalid="error")


def train_model(
    train: DataFrame,
    trees: int = TREES,
    depth: int = DEPTH,
    seed: int = SEED,
    label: str = S.LABEL,
    weight: str = "weight",
    **forest_params,
) -> PipelineModel:
    """Fit assembler and forest; ``forest_params`` go to the forest as they are.

    On large data raise ``maxMemoryInMB``: it decides how many tree nodes one
    pass over the data can split.

    The rows are computed and assembled once and kept on disk: the forest scans them
    several times before it keeps its own form of them, in the memory that is left to it.
    """
    forest = RandomForestClassifier(
        labelCol=label,
        featuresCol="features",
        weightCol=weight,
        numTrees=trees,
        maxDepth=depth,
        seed=seed,
        featureSubsetStrategy=FEATURE_SUBSET,
        **{**PASSES, **forest_params},
    )
    # Naming the number of classes saves the forest a pass to find it out.
    binary = {"ml_attr": {"type": "nominal", "num_vals": 2, "name": label}}
    train = train.withMetadata(label, binary)
    assembler = feature_stage()
    assembled = assembler.transform(train).select("features", label, weight)
    assembled.persist(StorageLevel.DISK_ONLY)
    try:
        return PipelineModel([assembler, forest.fit(assembled)])
    finally:
        assembled.unpersist()


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add the model's columns and ``Fraud_Probability``; batch or stream."""
    return model.transform(df).withColumn("Fraud_Probability", fraud_probability("probability"))


def auc(
    scored: DataFrame, score: str = "rawPrediction", label: str = S.LABEL, bins: int = 0
) -> float:
    """Area under the ROC curve; exact with no bins, tied scores count half."""
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol=score, labelCol=label, metricName="areaUnderROC", numBins=bins
    )
    return evaluator.evaluate(scored)
