"""Models at rest: a folder per version that never changes, and one that is current."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from riskflow.storage import (
    child_names,
    highest_number,
    path_exists,
    read_small,
    remove_folder,
    replace_small,
)

_CURRENT = "_current"
_VERSION = r"v(\d+)-[0-9a-f]+"

#: Versions that stay readable beside the current one, for whoever is just loading one.
KEPT = 5


def _folder(path: str) -> str:
    return f"{path}/versions"


def save_model(model: PipelineModel, path: str, keep: int = KEPT) -> str:
    """Write the model as a new version, make it the current one, and return its name.

    The former version stays current until the new one is whole: then a small file that
    names it is replaced in one rename. A save that fails on the way leaves a folder
    that nobody reads, which a later save removes. Of the older versions the last
    ``keep`` stay.
    """
    spark = SparkSession.active()
    last = highest_number(spark, _folder(path), _VERSION)
    name = f"v{1 if last is None else last + 1:06d}-{uuid.uuid4().hex[:8]}"
    model.write().save(f"{_folder(path)}/{name}")
    replace_small(spark, f"{path}/{_CURRENT}", name)
    for old in model_versions(spark, path, whole=False)[: -keep - 1]:
        remove_folder(spark, f"{_folder(path)}/{old}")
    return name


def current_version(spark: SparkSession, path: str) -> str | None:
    """The name of the current version; None where there is none."""
    name = read_small(spark, f"{path}/{_CURRENT}")
    return name.strip() if name else None


def model_versions(spark: SparkSession, path: str, whole: bool = True) -> list[str]:
    """Versions in the order they were begun; ``whole`` leaves out broken saves."""
    names = sorted(name for name in child_names(spark, _folder(path)) if name[0] not in "_.")
    # The stages are written last.
    return [n for n in names if not whole or path_exists(spark, f"{_folder(path)}/{n}/stages")]


def load_model(path: str, version: str | None = None) -> PipelineModel:
    """The current model, or one of the versions that are still there.

    A folder that holds a model itself, without versions, is read as that.
    """
    spark = SparkSession.active()
    name = version or current_version(spark, path)
    return PipelineModel.load(path if name is None else f"{_folder(path)}/{name}")


def use_version(path: str, version: str) -> None:
    """Make an older version the current one again."""
    spark = SparkSession.active()
    if version not in model_versions(spark, path):
        raise ValueError(f"{path} has no version {version}")
    replace_small(spark, f"{path}/{_CURRENT}", version)
