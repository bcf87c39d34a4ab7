"""Transaction risk analytics on Spark: scoring streams, daily totals, a model."""

from riskflow.session import build_session, pin_settings, scratch_dir

__all__ = ["build_session", "pin_settings", "scratch_dir"]
