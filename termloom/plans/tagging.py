"""Queries that tag the document records with the dictionary of entity names.

The corpus is test_documents (title, TAB, text of the first row of each key), the dictionary names with test_entities.
Where a query needs more, as a stop list, it takes a few fixed rows from ``fixtures``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.keys import canonical_key, skeleton
from termloom.functions.latin import character_spans, leading_integer
from termloom.operators import dictionary as D
from termloom.operators import render
from termloom.operators.markup import annotated, masked
from termloom.operators.matching import (
    blocked_by_pattern, found_keys, found_keys_by_organism, heads_hit, keyed_rows, mention_rows, overlapping_keys, wanted, with_blocked, with_entities,
)
from termloom.operators.pair_groups import group_scores, named_groups
from termloom.operators.pairs import pair_counts, pair_levels, pair_scores, pair_sums, typed_pairs
from termloom.operators.resolution import disambiguated, grouped
from termloom.operators.segments import inside_segments, segments
from termloom.operators.windows import byte_tokens, candidate_windows, tokens
from termloom.plans import fixtures as X
from termloom.sources.staging import checkpointed
from termloom.sources.tables import spread, table

MAX_TOKENS = 15


#: The name in the handlers and blocks of earlier annotations, in the query over pages.
MARKS = "Annotation"


def first_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, text``: the first loaded row of each document key, its title, a TAB and its text; rows without a key are left out.

    Which rows are repeated is found on the narrow columns; texts are neither sorted nor, as long as those are few, shuffled.
    """
    key = leading_integer(F.regexp_extract("identifier", r"^[^:|\t]*:([^|\t]*)", 1), "int")
    keyed = table(spark, folder, "test_documents", "row_id", "identifier").select("row_id", key.alias("doc_id")).where("doc_id <> 0")
    first = keyed.groupBy("doc_id").agg(F.min("row_id").alias("first"))
    repeated = keyed.join(first, "doc_id").where("row_id <> first").select("row_id")
    rows = spread(table(spark, folder, "test_documents", "row_id", "identifier", "title", "text")).withColumn("doc_id", key).where("doc_id <> 0")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\t"), F.coalesce("text", F.lit("")))
    return rows.join(repeated, "row_id", "left_anti").select("doc_id", text.alias("text"))


def name_rows(spark: SparkSession, folder: str) -> DataFrame:
    return D.names_with_entities(table(spark, folder, "names", "serial", "name"), table(spark, folder, "test_entities", "serial", "type", "identifier"))


def types_of(spark: SparkSession, folder: str) -> DataFrame:
    """``serial, type``: of several types of a serial the largest."""
    entities = table(spark, folder, "test_entities", "serial", "type").where("serial IS NOT NULL AND type IS NOT NULL")
    return entities.groupBy("serial").agg(F.max("type").alias("type"))


def requested(spark: SparkSession, folder: str) -> tuple[int, ...]:
    """The requested types: a short list that a user gives."""
    return tuple(r.type for r in table(spark, folder, "test_types").where("type IS NOT NULL").distinct().collect())


def stop_global(spark: SparkSession) -> DataFrame:
    return D.stop_list(X.rows(spark, X.STOP_GLOBAL, "name string, flag string"))


def stop_local(spark: SparkSession) -> DataFrame:
    return D.stop_list(X.rows(spark, X.STOP_LOCAL, "name string, doc_id string, flag string"), local=True)


def keyed(spark: SparkSession, folder: str, documents: DataFrame | None = None, stops: bool = False, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Windows that the dictionary has, with their key, and the rows of the dictionary with the entities. Both of the dictionary's tables are kept."""
    rows = checkpointed(name_rows(spark, folder) if rows is None else rows)
    heads = checkpointed(D.heads(rows, X.rows(spark, X.STOP_GLOBAL, "name string, flag string") if stops else None))
    windows = candidate_windows(first_documents(spark, folder) if documents is None else documents, heads, MAX_TOKENS)
    found = with_blocked(heads_hit(windows, heads), stop_global(spark) if stops else None, stop_local(spark) if stops else None)
    return found, rows


def keyed_matches(spark: SparkSession, folder: str, documents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Mentions of the requested types with their key, and the rows of the dictionary of these types."""
    types = requested(spark, folder)
    found, rows = keyed(spark, folder, documents)
    return found_keys(found, types), rows.where(wanted(F.col("type"), F.array(*map(F.lit, types)).cast("array<int>")))


def _listed(found: DataFrame, rows: DataFrame, types: tuple[int, ...] = ()) -> DataFrame:
    return keyed_rows(found, rows, types).select("doc_id", "start", "stop", "text", "type", "serial")


def _flat(found: DataFrame) -> DataFrame:
    return mention_rows(found).select("doc_id", "start", "stop", "text", "type", "serial")


def tokenize_documents(spark: SparkSession, folder: str) -> DataFrame:
    return tokens(first_documents(spark, folder)).select("doc_id", "i", "start", "stop", "token")


def tokenize_characters(spark: SparkSession, folder: str) -> DataFrame:
    """Every byte of the titles as a token, by its place and as hexadecimal digits."""
    titles = table(spark, folder, "test_documents", "row_id", "title").select(F.col("row_id").alias("doc_id"), F.col("title").alias("text"))
    return byte_tokens(spread(titles))


def _hex(key: Column) -> Column:
    """The bytes of a key."""
    return F.hex(F.encode(key, "ISO-8859-1"))


def canonical_keys(spark: SparkSession, folder: str) -> DataFrame:
    given = X.rows(spark, tuple((s,) for s in X.STRINGS), "name string")
    names = table(spark, folder, "names", "name").where("name IS NOT NULL").distinct()
    return given.union(names).distinct().select("name", _hex(canonical_key(F.col("name"))).alias("key"), _hex(skeleton(F.col("name"))).alias("skeleton"))


def stop_filter(spark: SparkSession, folder: str) -> DataFrame:
    given = X.rows(spark, tuple((s,) for s in X.STRINGS), "name string")
    names = table(spark, folder, "names", "name").where("name IS NOT NULL")
    return given.union(names).distinct().select("name", blocked_by_pattern(F.col("name")).alias("blocked"))


def dictionary_load(spark: SparkSession, folder: str) -> DataFrame:
    """Every name that is loaded, with its key and entity."""
    return name_rows(spark, folder).select(_hex(F.col("key")).alias("key"), "name", "type", "serial", "identifier")


def stub_names(spark: SparkSession, folder: str) -> DataFrame:
    return D.stub_names(name_rows(spark, folder), X.rows(spark, X.STOP_GLOBAL, "name string, flag string")).select("name", "type")


def mentions_longest(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: leftmost longest mentions of all types."""
    found, rows = keyed(spark, folder)
    return _listed(found_keys(found), rows)


def mentions_typed(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(*keyed_matches(spark, folder))


def mentions_overlap(spark: SparkSession, folder: str) -> DataFrame:
    found, rows = keyed(spark, folder)
    return _listed(overlapping_keys(found), rows)


def mentions_stop_lists(spark: SparkSession, folder: str) -> DataFrame:
    found, rows = keyed(spark, folder, stops=True)
    return _listed(found_keys(found), rows)


def mentions_autodetect(spark: SparkSession, folder: str) -> DataFrame:
    """Types found by organisms besides those requested; here entities of type -2 stand for organisms, each for one
    of four taxa by its serial, so that a document's organisms decide which types are found in it."""
    trigger = F.when(F.col("type") == -2, F.lit(-3)).otherwise(F.col("type"))
    found, rows = keyed(spark, folder, rows=name_rows(spark, folder).withColumn("type", trigger))
    organisms = types_of(spark, folder).where("type = -2").select("serial", F.element_at(F.array(*map(F.lit, X.TAXA)), (F.col("serial") % len(X.TAXA) + 1).cast("int")).alias("taxon"))
    return _listed(found_keys_by_organism(found, rows, organisms, (-26,)), rows)


def acronym_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions of acronyms and their long forms. The names of three or four words with a hyphen or space between give the texts: each with its
    initials in brackets, and the initials again, plain and hyphenated; documents are numbered by the name."""
    names = table(spark, folder, "names", "name").where(F.col("name").rlike(X.LONG_FORM)).distinct()
    initials = F.upper(F.regexp_replace("name", "(?i)([a-z])[a-z]*[ -]?", "$1"))
    given = names.select(F.xxhash64("name").alias("doc_id"), "name", initials.alias("short"))
    dashed = F.regexp_replace("short", "(?<=.)(?=.)", "-")
    text = F.concat(F.lit("The "), F.col("name"), F.lit(" ("), F.col("short"), F.lit(") binds "), F.col("short"), F.lit(" and "), dashed, F.lit("."))
    documents = checkpointed(given.select("doc_id", "name", text.alias("text")))
    hit, rows = keyed(spark, folder, documents.select("doc_id", "text"))
    found = _listed(found_keys(hit), rows)
    return found.join(documents.select("doc_id", "name"), "doc_id").select(F.col("name").alias("document"), "start", "stop", "text", "type", "serial")


def _unnamed(rows: DataFrame) -> DataFrame:
    """Rows of the dictionary for results that have no identifiers."""
    return rows.withColumn("identifier", F.lit(None).cast("string"))


def document_segments(spark: SparkSession, folder: str) -> DataFrame:
    return segments(first_documents(spark, folder)).select("doc_id", "paragraph", "sentence", "begin", "end")


def _structured(spark: SparkSession, folder: str) -> DataFrame:
    """Disambiguated mentions in their sentences. The documents are read for windows and for segments: deduplicated once."""
    documents = checkpointed(first_documents(spark, folder))
    found, rows = keyed_matches(spark, folder, documents)
    placed = inside_segments(disambiguated(with_entities(found, _unnamed(rows))), segments(documents))
    return placed.select("doc_id", "paragraph", "sentence", "ord", "start", "stop", "text", F.inline("entities"))


def mentions_structured(spark: SparkSession, folder: str) -> DataFrame:
    return _structured(spark, folder).select("doc_id", "paragraph", "sentence", "start", "stop", "text", "type", "serial")


def mentions_disambiguated(spark: SparkSession, folder: str) -> DataFrame:
    found, rows = keyed(spark, folder)
    return _flat(disambiguated(with_entities(found_keys(found), _unnamed(rows))))


def mentions_grouped(spark: SparkSession, folder: str) -> DataFrame:
    found, rows = keyed_matches(spark, folder)
    return _flat(grouped(with_entities(found, _unnamed(rows)), X.rows(spark, X.GROUPS, "child bigint, parent bigint"), types_of(spark, folder)))


def _given_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """The mentions table, with an order of the mentions of a document."""
    rows = table(spark, folder, "mentions", "doc", "paragraph", "sentence", "start", "serial").where("doc IS NOT NULL AND serial IS NOT NULL").distinct()
    return rows.select(F.col("doc").alias("doc_id"), "paragraph", "sentence", F.col("start").alias("ord"), "serial")


def pair_level_counts(spark: SparkSession, folder: str) -> DataFrame:
    return pair_levels(pair_counts(_given_mentions(spark, folder)))


def _scores(typed: DataFrame) -> DataFrame:
    return pair_scores(typed).select("serial1", "serial2", *(F.round(c, 6).alias(c) for c in ("score", "ratio", "s", "s_i", "s_j", "s_ij")))


def _sums(mentions: DataFrame) -> DataFrame:
    """Pair sums, kept: marginals, totals and the pairs themselves are read from them."""
    return checkpointed(pair_sums(pair_counts(mentions)))


def pair_scores_all(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(typed_pairs(_sums(_given_mentions(spark, folder)), types_of(spark, folder)))


def pair_scores_selective(spark: SparkSession, folder: str) -> DataFrame:
    allowed = X.rows(spark, X.TYPE_PAIRS, "type1 int, type2 int")
    return _scores(typed_pairs(_sums(_given_mentions(spark, folder)), types_of(spark, folder), allowed))


def corpus_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """From documents to scores: tagging, segments, disambiguation, levels, sums, scores; entities stay together as long as all of that is the same for them."""
    documents = checkpointed(first_documents(spark, folder))
    found, rows = keyed_matches(spark, folder, documents)
    placed = inside_segments(found.drop("text"), segments(documents), crossing=True)
    return group_scores(*named_groups(placed, rows), types_of(spark, folder))


def clean_dictionary_log(spark: SparkSession, folder: str) -> DataFrame:
    """Every removal, with the key, the name and what masks it."""
    log = D.cleaning_log(name_rows(spark, folder))
    return log.select("reason", _hex(F.col("key")).alias("key"), "name", "type", "serial", "count", "masked_type", "masked_serial")


def clean_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the names table that stay; repeated rows stay repeated."""
    names = table(spark, folder, "names", "serial", "name").where("serial IS NOT NULL AND name IS NOT NULL")
    return D.cleaned_names(names, D.cleaning_log(name_rows(spark, folder))).select("serial", "name")


def entities_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return render.distinct_keyed(*keyed_matches(spark, folder))


def entity_lines_csv(spark: SparkSession, folder: str) -> DataFrame:
    return render.lines_of(render.distinct_keyed(*keyed_matches(spark, folder)), "csv")


def entities_grouped(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions by their exact text, with each entity of the first one."""
    found, rows = keyed_matches(spark, folder)
    return render.grouped_keys(found).join(rows, "key").select("doc_id", "text", "count", "type", "serial", "identifier")


def entities_xml(spark: SparkSession, folder: str) -> DataFrame:
    found, rows = keyed_matches(spark, folder)
    return render.xml_of(with_entities(render.grouped_keys(found), rows))


def entities_jsonld(spark: SparkSession, folder: str) -> DataFrame:
    documents = checkpointed(first_documents(spark, folder))
    found, rows = keyed_matches(spark, folder, documents)
    return render.graphs(documents, render.annotations_keyed(documents, checkpointed(found), rows))


def entity_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """The annotations of the graph form, a row for each, with positions in code points."""
    documents = checkpointed(first_documents(spark, folder))
    found, rows = keyed_matches(spark, folder, documents)
    return render.annotations_keyed(documents, checkpointed(found), rows)


def entities_html(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as pages, their markup masked, tagged and annotated."""
    page = F.concat(F.lit("<html><head><title>x</title></head><body><p class=\"a\">"), F.replace("text", F.lit("\t"), F.lit("</p><p>")), F.lit("</p></body></html>"))
    pages = checkpointed(first_documents(spark, folder).select("doc_id", page.alias("text")))
    hidden = checkpointed(masked(pages, MARKS))
    found, rows = keyed_matches(spark, folder, hidden.select("doc_id", "text"))
    return annotated(pages, with_entities(found, rows), hidden, name=MARKS)


def entity_extract(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "names", "serial", "name").where("serial IS NOT NULL AND name IS NOT NULL").groupBy("serial").agg(F.min("name").alias("name"))
    labels = X.rows(spark, X.TYPE_NAMES, "type int, type_name string")
    found, rows = keyed_matches(spark, folder)
    return render.extract_table(keyed_rows(found, rows), labels, names)


def character_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """The mentions table with positions in code points."""
    rows = table(spark, folder, "mentions", "doc", "start", "stop").where("doc IS NOT NULL AND start IS NOT NULL AND stop IS NOT NULL").distinct()
    spans = character_spans(first_documents(spark, folder), rows.withColumnRenamed("doc", "doc_id"))
    return spans.select(F.col("doc_id").alias("doc"), "start", "stop", "begin", "end")


def resolve_names(spark: SparkSession, folder: str) -> DataFrame:
    """The identifiers' names of the mentions' surfaces: each distinct surface looked up in the dictionary."""
    asked = table(spark, folder, "mentions", "text").distinct().withColumnRenamed("text", "name")
    return D.resolve_names(asked, D.dictionary(name_rows(spark, folder))).select("name", "type", "serial")


def entity_iris(spark: SparkSession, folder: str) -> DataFrame:
    entities = table(spark, folder, "test_entities", "type", "identifier").where("type IS NOT NULL AND identifier IS NOT NULL").distinct()
    rows = entities.union(X.rows(spark, X.IRIS, "type int, identifier string")).distinct()
    return rows.select("type", "identifier", render.entity_iri(F.col("type"), F.col("identifier")).alias("iri"))


def environment_ids(spark: SparkSession, folder: str) -> DataFrame:
    serials = table(spark, folder, "test_entities", "serial").where("serial IS NOT NULL").distinct()
    few = X.rows(spark, tuple((s,) for s in (9999, 10000, 10199, 10200)), "serial bigint")
    return serials.union(few).select("serial", render.environment_id(F.col("serial")).alias("envo"))


def block_promotion(spark: SparkSession, folder: str) -> DataFrame:
    return D.promoted_blocks(X.rows(spark, X.BLOCKS, "name string, doc_id string"))


def dedup_documents(spark: SparkSession, folder: str) -> DataFrame:
    return first_documents(spark, folder).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), F.octet_length("text").alias("bytes"))


QUERIES = {
    f.__name__: f
    for f in (
        mentions_longest, mentions_typed, mentions_overlap, mentions_stop_lists, mentions_autodetect, mentions_structured, mentions_disambiguated, mentions_grouped,
        tokenize_documents, tokenize_characters, canonical_keys, stop_filter, dictionary_load, stub_names, document_segments, pair_level_counts, pair_scores_all,
        pair_scores_selective, corpus_pairs, clean_dictionary_log, clean_dictionary, entities_distinct, entity_lines_csv, entities_grouped, entities_xml, entities_jsonld,
        entities_html, entity_annotations, acronym_mentions, entity_extract, character_offsets, resolve_names, entity_iris, environment_ids, block_promotion, dedup_documents,
    )
}
