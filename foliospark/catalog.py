"""The engine's registered queries and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.plans import queries as plans


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: line items out of rendered invoices, summed by the buyer's nation."""
    return plans.revenue_by_nation_parsed(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.ORACLE_SQL)
