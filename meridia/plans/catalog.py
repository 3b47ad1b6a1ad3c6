"""All queries on the driver's tables and their SQL, by name."""

from __future__ import annotations

from . import geography_queries, pricing_queries, quality_queries, release_queries, text_queries, window_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "geography_queries", "pricing_queries", "quality_queries", "release_queries", "text_queries", "window_queries"]
