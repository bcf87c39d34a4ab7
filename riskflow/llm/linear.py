"""What the two text classifiers share: a bounded training sample, one fitting task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import text_of, workers_can_import

#: Hashed features: weights are one vector of this length.
DIMENSIONS = 1 << 18
#: Labelled documents that a model is fitted on, at most.
TRAINING_ROWS = 8000


def sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, text: str, id: str
) -> DataFrame:
    """(order, label, text) of at most ``rows`` labelled ids, the first by a hash of the id.

    ``learn`` says over ``labels`` which rows may be learnt from. Only ids are
    sorted; the chosen ones, at most ``rows``, are broadcast to the texts.
    """
    order = F.xxhash64(labels[id].cast("string"))
    chosen = (
        labels.filter(learn & labels[id].isNotNull() & labels[label].isNotNull())
        .groupBy(labels[id].alias("_id"))
        .agg(F.max(labels[label]).cast("double").alias("label"), F.max(order).alias("order"))
        .orderBy("order", "_id")
        .limit(rows)
    )
    texts = docs.select(docs[id].alias("_id"), text_of(docs, text).alias("text"))
    # Rows that repeat an id are joined before they are moved: the least text is learnt from.
    return (
        texts.join(F.broadcast(chosen), "_id")
        .groupBy("_id", "order", "label")
        .agg(F.min("text").alias("text"))
        .select("order", "label", "text")
    )


def fitted(
    rows: DataFrame,
    features: Callable,
    feature_type: str,
    fit: Callable[[list[dict]], np.ndarray],
) -> np.ndarray:
    """Features where the texts are, the fit in one task over the bounded sample."""
    workers_can_import(rows.sparkSession)

    def train(batches):
        known = [row for batch in batches for row in batch.to_pylist()]
        weights = fit(known).astype(np.float32)
        yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()]})

    one = (
        rows.mapInArrow(features, f"order long, label double, {feature_type}")
        .repartition(1)
        .sortWithinPartitions("order", "label", *[c.split()[0] for c in feature_type.split(", ")])
        .mapInArrow(train, "weights binary")
        .first()
    )
    if one is None:  # nothing to learn from, and so no task
        return fit([]).astype(np.float32)
    return np.frombuffer(bytes(one["weights"]), np.float32)
