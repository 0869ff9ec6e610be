"""Registered queries, grouped as in the inventory. Importing the package fills the registry."""

from carnet.registry import ORACLES, QUERIES
from carnet.plans import cohort, context, correction, learning, reconcile, records, sources, text, timeline, vocabulary  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
