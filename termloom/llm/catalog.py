"""All queries of the subpackage."""

from __future__ import annotations

from termloom.llm import cooccurrence_queries, encoding_queries, frequency_queries, mixing_queries, sentence_queries, stuffing_queries

MODULES = (cooccurrence_queries, encoding_queries, frequency_queries, mixing_queries, sentence_queries, stuffing_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
