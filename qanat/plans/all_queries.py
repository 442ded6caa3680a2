"""Imports every query module, so that the registry is complete."""

from . import queries_anomaly, queries_events, queries_forecast, queries_gold, queries_ledger, queries_readmodels  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
