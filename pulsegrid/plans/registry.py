"""All queries over the driver tables: name -> function of (spark, sf_dir), and the SQL that must give the same rows."""

from __future__ import annotations

from . import alert_queries, detector_queries, exploration_queries, feature_queries, forecast_queries, join_queries, model_queries, promql_queries, source_queries, stream_queries, window_queries  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
