"""Composed jobs."""

from riskflow.plans.daily import run_daily
from riskflow.plans.incremental import daily_state, run_daily_incremental
from riskflow.plans.replaying import run_replay
from riskflow.plans.scoring import run_stream
from riskflow.plans.training import TRAINING_TASKS, TrainingReport, run_training
from riskflow.plans.warehouse import setup_catalog

__all__ = [
    "TRAINING_TASKS",
    "TrainingReport",
    "daily_state",
    "run_daily",
    "run_daily_incremental",
    "run_replay",
    "run_stream",
    "run_training",
    "setup_catalog",
]
