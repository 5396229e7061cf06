"""Queries over the document feed: lines that fail to parse, and packed author fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators.malformed import loaded_lines, rejected_lines
from termloom.operators.packed import split_packed
from termloom.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "raw_documents", "line_id", "line")
    return rejected_lines(lines).select("line_id")


def p1_rejected(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "raw_documents", "line_id", "line")
    return rejected_lines(lines).select("line_id", F.array_join("reasons", ",").alias("reasons"))


def p1_loaded(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "raw_documents", "line_id", "file_name", "line", "received_at")
    return loaded_lines(lines).drop("received_at")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_packed(table(spark, folder, "test_documents", "row_id", "authors"), "row_id", "authors", value_name="author")


QUERIES = {"p1_found": p1_found, "p1_rejected": p1_rejected, "p1_loaded": p1_loaded, "p4_found": p4_found}

#: One field of a line: wrapped in quotes, or anything without a TAB that doesn't begin with a quote.
_FIELD = r'("(?:[^"]|"")*"|[^"\t][^\t]*|)'
_LINE = r"\A" + r"\t".join([_FIELD] * 6) + r"\z"
_PARSED = f"""
WITH body AS (
  SELECT *, CASE WHEN line LIKE '%' || chr(13) THEN left(line, length(line) - 1) ELSE line END AS body FROM raw_documents
), fields AS (
  SELECT *, regexp_matches(body, '(?s){_LINE}') AS sound,
    regexp_extract(body, '(?s){_LINE}', ['a', 'b', 'c', 'd', 'e', 'f']) AS x
  FROM body
), plain AS (
  SELECT *, list_transform([x.a, x.b, x.c, x.d, x.e, x.f], lambda v: CASE WHEN v LIKE '"%' THEN replace(substr(v, 2, length(v) - 2), '""', '"') ELSE v END) AS f FROM fields
), numbered AS (
  SELECT *, regexp_matches(f[6], '[^\\x{{09}}-\\x{{0D}}\\x{{20}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]') AS has_text, try_cast(regexp_extract(f[1], '(?s)\\A[A-Za-z]+:0*([0-9]{{1,10}})(\\|.*)?\\z', 1) AS BIGINT) AS number FROM plain
), judged AS (
  SELECT *, coalesce(sound
      AND number BETWEEN 1 AND 2147483647
      AND (f[4] = '' OR (regexp_full_match(f[4], '[0-9]{{4}}') AND f[4] BETWEEN '1800' AND '2100'))
      AND has_text
      AND NOT regexp_matches(array_to_string(f, chr(9)), '[\\x00-\\x08\\x0A-\\x1F\\x7F-\\x{{9F}}\\x{{FFFD}}]'), false) AS valid
  FROM numbered
)
"""

_WRAPPED = r'(^|\t)"(?:[^"]|"")*"([^"\t][^\t]*)?'
_NAMES = ("identifier", "authors", "journal", "year", "title", "text")
_CONTROL = r"[\x00-\x08\x0A-\x1F\x7F-\x{9F}\x{FFFD}]"
#: Why a line fails: its structure, told from what is left without closed wrapped fields, or else its fields.
_REASONS = f"""{_PARSED}, rest AS (
  SELECT *, regexp_extract_all(body, '{_WRAPPED}', 2) AS junk, regexp_replace(body, '{_WRAPPED}', '\\1', 'g') AS bare FROM judged
), structure AS (
  SELECT *, regexp_matches(bare, '(^|\\t)"') AS open_, len(string_split(bare, chr(9))) AS n FROM rest
)
SELECT line_id, array_to_string(list_sort(list_filter(
  CASE WHEN line IS NULL THEN ['line_null']
  WHEN NOT sound THEN [CASE WHEN open_ THEN 'quote_not_closed' END, CASE WHEN len(list_filter(junk, lambda x: x <> '')) > 0 THEN 'quote_closed_inside' END, CASE WHEN NOT open_ AND n <> 6 THEN 'field_count' END]
  ELSE [{", ".join(f"CASE WHEN regexp_matches(f[{k}], '{_CONTROL}') THEN '{name}_control_character' END" for k, name in enumerate(_NAMES, 1))},
    CASE WHEN NOT coalesce(number BETWEEN 1 AND 2147483647, false) THEN 'identifier_invalid' END,
    CASE WHEN NOT (f[4] = '' OR (regexp_full_match(f[4], '[0-9]{{4}}') AND f[4] BETWEEN '1800' AND '2100')) THEN 'year_invalid' END,
    CASE WHEN NOT has_text THEN 'text_blank' END] END, lambda x: x IS NOT NULL)), ',') AS reasons
FROM structure WHERE NOT valid"""

ORACLES = {
    "p1_found": _PARSED + "SELECT line_id FROM judged WHERE NOT valid",
    "p1_loaded": _PARSED
    + """SELECT line_id, file_name, f[1] AS identifier, f[2] AS authors, f[3] AS journal, f[4] AS year, f[5] AS title, f[6] AS text
    FROM judged WHERE valid""",
    "p1_rejected": _REASONS,
}
