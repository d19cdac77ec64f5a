"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import coverage_queries, facts_queries, java_queries, report_queries, source_queries, stage_queries, surface_queries, text_queries  # noqa: F401  (they register themselves)
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which candidates the incremental filter keeps over the baseline, and what each adds."""
    return QUERIES["incremental_filter"](spark, sf_dir)
