"""The whole query pack."""

from tidemark.plans import ingest, models, selection, signals, strategies, streams, sweeps  # noqa: F401
from tidemark.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
