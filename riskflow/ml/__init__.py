"""Model training, scoring, evaluation and versions."""

from riskflow.ml.area import Area, auc_bounds
from riskflow.ml.forest import auc, feature_stage, score, train_model
from riskflow.ml.versions import (
    current_version,
    load_model,
    model_versions,
    save_model,
    use_version,
)

__all__ = [
    "Area",
    "auc",
    "auc_bounds",
    "current_version",
    "feature_stage",
    "load_model",
    "model_versions",
    "save_model",
    "score",
    "train_model",
    "use_version",
]
