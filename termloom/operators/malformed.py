"""Rows of a delimited feed that fail to parse, apart from the rows that load.

A line is split into cells by a quote-aware fold over its delimiter-separated pieces, the cells are exploded into
(row, column, value), joined with a small rule table, validated, and the failures are aggregated per line. The clean
rows are what is left after an anti-join with the failures.

Defined results: a null or empty line is rejected (``field_count``); repeated lines are judged one by one; two rows
that share a ``line_id`` but not the line are judged apart; null ids are kept; other columns of the input are ignored,
whatever their names. An empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("identifier", "authors", "journal", "year", "title", "text")

#: (column, kind of validation, lower bound, upper bound, reason; null: the value is the reason). A fixed handful of rows: broadcast whatever the data's size.
RULES = (
    *((name, "no_control", None, None, f"{name}_control_character") for name in FIELDS),
    ("line", "never", None, None, None),
    ("identifier", "leading_number", 1, 2147483647, "identifier_invalid"),
    ("year", "optional_year", 1800, 2100, "year_invalid"),
    ("text", "not_blank", None, None, "text_blank"),
)

RULE_SCHEMA = "column string, kind string, low bigint, high bigint, reason string"


def rule_table(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def _fold(pieces: str, keep: int) -> str:
    """SQL of the fold over the TAB-separated pieces of a line.

    A piece that opens with a quote starts a wrapped field. With doubled quotes taken out from the left, the first
    quote that is left closes it and must be the last character; without one, the field goes on behind the TAB. Only
    the spans of the first ``keep`` fields are stored, so that a line of a million TABs stays linear.
    """
    rest = "replace(if(s.open, p, substring(p, 2)), '\"\"', '')"
    quoted = "(s.open OR startswith(p, '\"'))"
    lone = f"instr({rest}, '\"')"
    return f"""
    aggregate({pieces},
      named_struct('open', false, 'bad', false, 'first', 1, 'at', 1, 'n', 0,
                   'spans', cast(array() as array<struct<first:int,count:int,wrapped:boolean>>)),
      (s, p) -> named_struct(
        'open', {quoted} AND {lone} = 0,
        'bad', s.bad OR ({quoted} AND {lone} > 0 AND {lone} < length({rest})),
        'first', if({quoted} AND {lone} = 0, s.first, s.at + 1),
        'at', s.at + 1,
        'n', s.n + if({quoted} AND {lone} = 0, 0, 1),
        'spans', if(({quoted} AND {lone} = 0) OR s.n >= {keep}, s.spans,
                    concat(s.spans, array(named_struct('first', s.first, 'count', s.at - s.first + 1, 'wrapped', {quoted}))))))
    """


def _plain(pieces: str, keep: int) -> str:
    """The state of a line: without a quote at the start of a piece it is known at once."""
    return f"""
    if(coalesce(exists({pieces}, p -> startswith(p, '"')), false), {_fold(pieces, keep)},
      named_struct('open', false, 'bad', false, 'first', 1, 'at', 1, 'n', size({pieces}),
                   'spans', transform(sequence(1, least({keep}, greatest(1, size({pieces})))),
                                      i -> named_struct('first', i, 'count', 1, 'wrapped', false))))
    """


def parse_lines(lines: DataFrame, fields: tuple[str, ...] = FIELDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per line: ``line_id, line_hash, <keep>, cells`` (array of the field values) and ``problems`` (array of reasons)."""
    width = len(fields)
    body = "if(endswith(line, '\\r'), left(line, length(line) - 1), line)"
    span = "array_join(slice(pieces, f.first, f.count), '\\t')"
    return (
        lines.select("line_id", F.xxhash64("line").alias("line_hash"), *keep, F.expr(f"split({body}, '\\t', -1)").alias("pieces"))
        # A generator keeps the optimizer from copying the fold into every expression that uses its result.
        .select("*", F.expr(f"inline(array({_plain('pieces', width + 1)}))"))
        .withColumn(
            "cells",
            F.expr(
                f"transform(spans, f -> if(f.wrapped, replace(substring({span}, 2, length({span}) - 2), '\"\"', '\"'), {span}))"
            ),
        )
        .withColumn(
            "problems",
            F.expr(
                f"""array_compact(array(
                if(pieces IS NULL, 'line_null', NULL),
                if(open, 'quote_not_closed', NULL),
                if(bad, 'quote_closed_inside', NULL),
                if(pieces IS NOT NULL AND NOT open AND n <> {width}, 'field_count', NULL)))"""
            ),
        )
        .select("line_id", "line_hash", *keep, "cells", "problems")
    )


def explode_cells(parsed: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Long form ``line_id, line_hash, column, value``.

    A line of sound structure gives a row per field; any other line a row per problem, with the column ``line``, so
    that one pass over the input judges structure and values.
    """
    names = ", ".join(f"'{x}'" for x in fields)
    cells = f"zip_with(array({names}), cells, (c, v) -> named_struct('column', c, 'value', v))"
    problems = "transform(problems, v -> named_struct('column', 'line', 'value', v))"
    return parsed.select("line_id", "line_hash", F.expr(f"inline(if(size(problems) = 0, {cells}, {problems}))"))


def failed_cells(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """``line_id, line_hash, reason`` of each cell that breaks a rule. ``rules`` has a fixed few rows and is broadcast."""
    number = F.expr("try_cast(regexp_extract(value, '\\\\A[A-Za-z]+:0*([0-9]{1,10})(?:\\\\|[\\\\s\\\\S]*)?\\\\z', 1) AS bigint)")
    year = F.expr("try_cast(regexp_extract(value, '\\\\A([0-9]{4})\\\\z', 1) AS bigint)")
    within = lambda x: F.coalesce(x.between(F.col("low"), F.col("high")), F.lit(False))
    valid = (
        F.when(F.col("kind") == "never", F.lit(False))
        .when(F.col("kind") == "no_control", ~F.col("value").rlike(r"[\x00-\x08\x0A-\x1F\x7F-\x9F\uFFFD]"))
        .when(F.col("kind") == "leading_number", within(number))
        .when(F.col("kind") == "optional_year", (F.col("value") == "") | within(year))
        .when(F.col("kind") == "not_blank", F.col("value").rlike(r"[^\p{IsWhite_Space}]"))
    )
    return cells.join(F.broadcast(rules), "column").where(~valid).select(
        "line_id", "line_hash", F.coalesce("reason", "value").alias("reason")
    )


def line_errors(parsed: DataFrame, rules: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``line_id, line_hash, reasons``: one row per line that fails, with its sorted distinct reasons."""
    return (
        failed_cells(explode_cells(parsed, fields), rules)
        .groupBy("line_id", "line_hash")
        .agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
    )


def rejected_lines(lines: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``line_id, line_hash, reasons`` of the lines that can't be loaded."""
    return line_errors(parse_lines(lines), rule_table(lines.sparkSession) if rules is None else rules)


def loaded_lines(lines: DataFrame, rules: DataFrame | None = None, keep: tuple[str, ...] = ("file_name", "received_at")) -> DataFrame:
    """The valid lines as ``line_id, <keep>, identifier, authors, journal, year, title, text``."""
    parsed = parse_lines(lines, keep=keep)
    errors = line_errors(parsed, rule_table(lines.sparkSession) if rules is None else rules).select(
        F.col("line_id").alias("bad_id"), F.col("line_hash").alias("bad_hash")
    )
    clean = parsed.join(
        errors, F.col("line_id").eqNullSafe(F.col("bad_id")) & (F.col("line_hash") == F.col("bad_hash")), "left_anti"
    )
    return clean.select("line_id", *keep, *(F.col("cells")[i].alias(name) for i, name in enumerate(FIELDS)))
