"""All queries over the driver's tables."""

from __future__ import annotations

from . import more_queries, record_queries, replay_queries, run_queries, source_queries, sql_queries, stream_queries, text_queries  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

FLAGSHIP = "r03_search_prose"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
