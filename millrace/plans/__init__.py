"""Registered queries: every operator applied to the given tables."""

from millrace.plans import audit, goals, ingest, profiling, registry, training  # noqa: F401
from millrace.plans.common import ORACLES, QUERIES
from millrace.plans.goals import autopilot as flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
