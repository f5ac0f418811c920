"""Registered queries of the library and their SQL counterparts."""

from __future__ import annotations

from bandlake.plans import corpus_queries, probe_queries, series_queries, source_queries  # noqa: F401  they register themselves
from bandlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
