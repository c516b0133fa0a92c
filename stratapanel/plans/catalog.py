"""All bound queries and oracles, by import of the query modules."""

from __future__ import annotations

# Later modules use oracle fragments of earlier ones.
from stratapanel.plans import series_queries  # noqa: F401
from stratapanel.plans import report_queries  # noqa: F401
from stratapanel.plans import data_queries  # noqa: F401
from stratapanel.plans import live_queries  # noqa: F401
from stratapanel.plans import model_queries  # noqa: F401
from stratapanel.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
