"""All queries of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.plans import feeds, programs, tagging, tagging_sql

QUERIES = {**tagging.QUERIES, **programs.QUERIES, **feeds.QUERIES}
ORACLES = {**tagging_sql.ORACLES, **feeds.ORACLES}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return tagging.mentions_longest(spark, folder)
