"""Composite analyses and the registered queries."""

from . import baseline, composites, metrics, operations, records, shapes, studies
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "baseline", "composites", "metrics", "operations", "records", "shapes", "studies"]
