"""All queries of the reference's own operators, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioforge.plans import native_queries, round_trips

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = native_queries.QUERIES | round_trips.QUERIES
ORACLE: dict[str, str] = native_queries.ORACLE | round_trips.ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as PDFs, converted."""
    return QUERIES["round_trip_pdf"](spark, sf_dir)
