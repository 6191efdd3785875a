"""All queries of the archive operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import queries as _queries
from . import queries_more as _more  # noqa: F401  it registers its queries


def queries() -> dict:
    return dict(_queries.QUERIES)


def oracle_sql() -> dict:
    return dict(_queries.SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much deduplication saves, by language."""
    return _queries.a17_dedup_by_language(spark, sf_dir)
