"""Queries that encode texts with the public byte-level vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.llm.bpe import encode_texts
from termloom.sources.tables import table


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents", "doc_id", "text"))


QUERIES = {"p6_ids": p6_ids}
ORACLES: dict[str, str] = {}
