"""Queries over the entities that are named in the same document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.cooccurrence import SIGNIFICANT, above_chance, judged_pairs
from termloom.sources.tables import table


def document_items(spark: SparkSession, folder: str) -> DataFrame:
    """``doc, serial`` of the mentions whose entity has a requested type, a row for each mention."""
    mentions = table(spark, folder, "mentions", "doc", "serial")
    wanted = table(spark, folder, "test_entities", "serial", "type").join(table(spark, folder, "test_types"), "type", "left_semi")
    return mentions.join(wanted.select("serial"), "serial", "left_semi").select("doc", "serial")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = above_chance(judged_pairs(document_items(spark, folder), "doc", "serial", 5), 4)
    return found.select(F.col("item1").alias("serial1"), F.col("item2").alias("serial2"))


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of items in any common document, with how far it lies above chance, and whether that is significant."""
    pairs = judged_pairs(document_items(spark, folder), "doc", "serial", 1)
    return pairs.select(
        F.col("item1").alias("serial1"), F.col("item2").alias("serial2"), "n12", "n1", "n2", "n", F.round("lift", 4).alias("lift"), F.round("llr", 4).alias("llr"), "significant"
    )


QUERIES = {"p2_found": p2_found, "p2_pairs": p2_pairs}

_PAIRS = """
WITH items AS (
  SELECT DISTINCT doc, serial FROM mentions WHERE doc IS NOT NULL
    AND serial IN (SELECT serial FROM test_entities WHERE type IN (SELECT type FROM test_types))
), one AS (SELECT serial, count(*) AS c FROM items GROUP BY serial
), total AS (SELECT count(DISTINCT doc) AS n FROM items
), pairs AS (
  SELECT a.serial AS serial1, b.serial AS serial2, count(*) AS n12
  FROM items a JOIN items b ON a.doc = b.doc AND a.serial < b.serial GROUP BY ALL
), counted AS (
  SELECT serial1, serial2, n12, x.c AS n1, y.c AS n2, n
  FROM pairs JOIN one x ON x.serial = serial1 JOIN one y ON y.serial = serial2, total
)
"""
_X = "CASE WHEN {0} > 0 THEN ({0}) * ln(CAST({0} AS DOUBLE)) ELSE 0 END"
_LLR = " + ".join(_X.format(x) for x in ("n12", "n1 - n12", "n2 - n12", "n - n1 - n2 + n12", "n")) + "".join(" - " + _X.format(x) for x in ("n1", "n - n1", "n2", "n - n2"))

ORACLES = {
    "p2_found": _PAIRS + "SELECT serial1, serial2 FROM counted WHERE n12 >= 5 AND CAST(n12 AS HUGEINT) * n >= 4 * CAST(n1 AS HUGEINT) * n2",
    "p2_pairs": _PAIRS
    + f"""SELECT serial1, serial2, n12, n1, n2, n, round(CAST(n12 AS DOUBLE) * n / n1 / n2, 4) AS lift, round(2 * ({_LLR}), 4) AS llr,
      CAST(n12 AS DOUBLE) * n / n1 / n2 > 1 AND 2 * ({_LLR}) >= {SIGNIFICANT} AS significant
    FROM counted""",
}
