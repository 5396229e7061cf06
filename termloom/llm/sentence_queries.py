"""Queries over the sentences of the document records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.sentences import split_sentences
from termloom.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_sentences(table(spark, folder, "test_documents", "row_id", "title", "text"), "row_id", ("title", "text"))


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences and code points per record and field."""
    return (
        p3_found(spark, folder)
        .groupBy("row_id", "field")
        .agg(F.count("*").alias("n_sentences"), F.sum(F.col("end_pos") - F.col("begin_pos")).alias("n_points"))
    )


QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts}
ORACLES: dict[str, str] = {}
