"""Queries over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalogue, q_agree, q_bridge, q_enrich, q_graph, q_infer, q_map, q_more, q_score, q_sources, q_stats, q_survive  # noqa: F401  (each fills the catalogue)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = catalogue.QUERIES
ORACLES: dict[str, str] = catalogue.ORACLES
