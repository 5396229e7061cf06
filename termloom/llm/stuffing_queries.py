"""Queries for pages stuffed with keywords, links or product tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.llm.stuffing import stuffed_pages
from termloom.sources.tables import table


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffed_pages(table(spark, folder, "documents", "doc_id", "lang", "text", "site"))


QUERIES = {"p8_found": p8_found}
ORACLES: dict[str, str] = {}
