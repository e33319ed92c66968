"""Registered queries, by import of the modules that define them."""

from driftwatch.plans import alerts, ingest, labelling, matching, models, quality, streams, windows  # noqa: F401
from driftwatch.plans.registry import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]
