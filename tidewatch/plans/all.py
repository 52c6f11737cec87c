"""Imports every module that registers queries."""

from . import audit_plans, detector, joins_plans, model_plans, more_plans, residual_plans, series_plans, stats_plans, stream_plans  # noqa: F401
