"""All core queries by name, with their SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import analytics, building, relational
from .registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The explainable filter: each order with the reasons for which it is rejected."""
    return QUERIES[relational.f1_rejection_reasons.__name__](spark, sf_dir)


def queries() -> dict:
    assert analytics.__name__ and building.__name__  # importing the module registers its queries
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
