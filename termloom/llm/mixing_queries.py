"""Queries that combine documents by source, sized in tokens of the public byte-level vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.bpe import token_counts
from termloom.llm.mixing import LEVELS, budgets, reached_shares, select_documents, sized
from termloom.sources.staging import checkpointed
from termloom.sources.tables import table


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with their numbers of tokens, encoded once: every later step reads the checkpoint."""
    documents = table(spark, folder, "documents", "doc_id", "source", "lang", "site", "text")
    return checkpointed(sized(token_counts(documents, keep=("doc_id", "source", "lang", "site"))))


def _selected(spark: SparkSession, folder: str) -> DataFrame:
    documents = _sized(spark, folder)
    return select_documents(documents, budgets(documents, table(spark, folder, "mix_targets")))


def p7_selected(spark: SparkSession, folder: str) -> DataFrame:
    return _selected(spark, folder)


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return reached_shares(_selected(spark, folder), table(spark, folder, "mix_targets"))


def p7_budgets(spark: SparkSession, folder: str) -> DataFrame:
    leaves = budgets(_sized(spark, folder), table(spark, folder, "mix_targets"))
    return leaves.select(*LEVELS, F.col("tokens").cast("bigint").alias("tokens"), "max_repeats", F.round("budget", 3).alias("budget"))


QUERIES = {"p7_selected": p7_selected, "p7_shares": p7_shares, "p7_budgets": p7_budgets}
ORACLES: dict[str, str] = {}
