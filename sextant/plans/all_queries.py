"""Imports every module that registers queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sextant.plans import coverage_queries, graph_queries, lookup_queries, score_queries, source_queries  # noqa: F401
from sextant.plans.derived import Tables


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage status per feature in the latest run."""
    return coverage_queries.a01(Tables(spark, sf_dir))
