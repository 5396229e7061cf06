"""Queries over the words of entity names and the types of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.frequency import marked, ngram_counts, words_of
from termloom.sources.tables import table


#: The letter before each word that tells its field, so that both fields are counted in one pass.
FIELDS = {"name": "n", "type": "t"}


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    """``serial, words`` of both fields, each word behind the letter of its field."""
    names = table(spark, folder, "names", "serial", "name").select("serial", words_of(F.col("name")).alias("words"))
    types = table(spark, folder, "test_entities", "serial", "type").where("type IS NOT NULL").select("serial", F.array(F.col("type").cast("string")).alias("words"))
    marked_words = lambda field: F.transform("words", lambda w: F.concat(F.lit(FIELDS[field]), w)).alias("words")
    return names.select("serial", marked_words("name")).unionByName(types.select("serial", marked_words("type")))


def _terms(spark: SparkSession, folder: str, most: int | None) -> DataFrame:
    rows = _rows(spark, folder)
    letter = F.substring("ngram", 1, 1)
    # As many rows as fields.
    totals = rows.where(F.size("words") > 0).groupBy(F.substring(F.col("words")[0], 1, 1).alias("letter")).agg(F.countDistinct("serial").alias("total"))
    counts = ngram_counts(rows, "serial", F.col("words"), most=most).withColumn("letter", letter).join(F.broadcast(totals), "letter")
    term = F.array_join(F.transform(F.split("ngram", " "), lambda w: F.substring(w, 2, 1 << 30)), " ")
    field = F.when(F.col("letter") == FIELDS["name"], "name").otherwise("type")
    return marked(counts, F.col("total")).select(field.alias("field"), term.alias("term"), "n", "occurrences", "records", "mark")


def p5_terms(spark: SparkSession, folder: str) -> DataFrame:
    """``field, term, n, occurrences, records, mark`` of every n-gram of every length."""
    return _terms(spark, folder, None)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The intervals of one word of the same suffix arrays, marked ones only."""
    return _terms(spark, folder, 1).where("mark IS NOT NULL").select("field", "term", "mark")


QUERIES = {"p5_found": p5_found, "p5_terms": p5_terms}

_WORDS = r"""
WITH split AS (
  SELECT row_number() OVER () AS row_no, serial, list_filter(list_transform(
      regexp_split_to_array(lower(name), '[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'),
      lambda w: trim(w, '()[],;.:"''')), lambda w: w <> '') AS w
  FROM names WHERE serial IS NOT NULL AND name IS NOT NULL
), grams AS (
  SELECT 'name' AS field, serial, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS term
  FROM (SELECT serial, w, unnest(range(1, len(w) + 1)) AS n FROM split)
  UNION ALL SELECT 'type', serial, 1, CAST(type AS VARCHAR) FROM test_entities WHERE type IS NOT NULL AND serial IS NOT NULL
), totals AS (SELECT field, count(DISTINCT serial) AS total FROM grams WHERE n = 1 GROUP BY field
), counted AS (
  SELECT field, term, CAST(n AS INTEGER) AS n, count(*) AS occurrences, count(DISTINCT serial) AS records FROM grams GROUP BY ALL
), marks AS (
  SELECT field, term, n, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records * 10 > total THEN 'common' END AS mark
  FROM counted JOIN totals USING (field)
)
"""
ORACLES = {
    "p5_found": _WORDS + "SELECT field, term, mark FROM marks WHERE n = 1 AND mark IS NOT NULL",
    "p5_terms": _WORDS + "SELECT field, term, n, occurrences, records, mark FROM marks",
}
