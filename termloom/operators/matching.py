"""Mentions of dictionary names: lookup, stop lists, types, and the choice of the leftmost longest.

A window is terminal if it hits a stub, or a name that isn't blocked and has an entity of a wanted type. At each token
the longest terminal window wins; after a mention the search goes on behind it, after a stub at the next token.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.latin import latin
from termloom.operators.dictionary import ENTITY, entities_by_key

# Fixed value: the default pattern of names that are no names: too short, numbers with units, residues with positions,
# and phrases that begin with, hold or end in function words. \Z is written so that line ends may follow.
_Z = r"(?=[\n\r\f]*\z)"
STOP_PATTERN = (
    r"(?s)\A&|\A(.{0,2}|.[ \t\r\n-]+.|[^A-Za-z]*([ \t\r\n]|" + _Z + r")|[ACDEFGHIKLMNPQRSTVWY]-?[0-9]{1,4}|[Oo][Rr][ -]*[0-9]+|[CJnsXx][ -]*[0-9.-]+"
    r"|[0-9]{1,4}[A-Za-z]|[0-9.-]+[ -]*[cGkMmnp]?[ABbdghLlMmSsVXx]\(?[0-9-]*\)?|[0-9] .{2,9})" + _Z +
    r"|\A([DGNSTdgnst]o|[Aa][nst]?|[Aa]nd|[Aa]re|[Bb][ey]|[Bb]ut|[Cc]an|[Dd]id|[Ff]or|[Hh]a[ds]|[Hh]ave|[Ii][fnst]|[Ii]ts|[Oo][fnr]|s|[Tt]he|[Tt]his|[Ww]as|[Ww]ere)[ \t\r\n]"
    r"|[ \t\r\n]([dgs]o|are|but|can|did|et|ha[ds]|have|i[fst]|its|this|was|were)[ \t\r\n]"
    r"|[ \t\r\n]([dgnst]o|a[nst]?|and|are|b[ey]|but|can|did|et|for|ha[ds]|have|i[fnst]|its|o[fnr]|the|this|was|were)" + _Z
)


def blocked_by_pattern(name: Column, pattern: str = STOP_PATTERN) -> Column:
    return latin(name).rlike(pattern)


def dictionary_hits(windows: DataFrame, words: DataFrame) -> DataFrame:
    """Windows joined with their dictionary entry: adds ``is_stub, entities``. The join's strategy is Spark's, by size."""
    return windows.join(words.select("key", "is_stub", "entities"), "key").drop("key")


def with_blocked(hits: DataFrame, stop_global: DataFrame | None = None, stop_local: DataFrame | None = None, pattern: str = STOP_PATTERN) -> DataFrame:
    """Adds ``blocked``: by the document's stop list, else by the global one, else by the pattern. Names compare exactly."""
    order: list[Column] = []
    if stop_local is not None:
        local = stop_local.select(F.col("doc_id").cast("string").alias("l_doc"), F.col("name").alias("l_name"), F.col("blocked").alias("l_blocked"))
        hits = hits.join(local, (F.col("doc_id").cast("string") == F.col("l_doc")) & (F.col("text") == F.col("l_name")), "left")
        order.append(F.col("l_blocked"))
    if stop_global is not None:
        known = stop_global.select(F.col("name").alias("g_name"), F.col("blocked").alias("g_blocked"))
        hits = hits.join(known, F.col("text") == F.col("g_name"), "left")
        order.append(F.col("g_blocked"))
    blocked = F.coalesce(*order, blocked_by_pattern(F.col("text"), pattern))
    return hits.withColumn("blocked", blocked).drop("l_doc", "l_name", "l_blocked", "g_name", "g_blocked")


def wanted(entity_type: Column, types: Column) -> Column:
    """Whether a type is asked for: by an empty list, by 0 for all from 0 on, or by itself."""
    return (F.size(types) == 0) | ((entity_type >= 0) & F.array_contains(types, F.lit(0))) | F.array_contains(types, entity_type)


def terminal(hits: DataFrame, types: Column) -> DataFrame:
    """The windows that end a search, with their entities of the wanted types."""
    kept = hits.withColumn("entities", F.filter("entities", lambda e: wanted(e["type"], types)))
    return kept.where(F.col("is_stub") | (~F.col("blocked") & (F.size("entities") > 0)))


MATCHES = f"doc_id {{id}}, ord int, start int, stop int, text string, entities array<{ENTITY}>"


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``doc_id, seg, i, j, is_stub`` and what goes with a window, sorted by document, run, first token and falling last token.

    What is kept between rows is the place in the run and the last token taken, so a document of any number of windows is
    one pass over its rows.
    """
    doc, seg, place, taken, ord_ = None, -1, -1, -1, 0
    for batch in batches:
        chosen, orders = [], []
        for k, (d, g, i, j, stub) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
            if d != doc:
                doc, seg, place, taken, ord_ = d, g, -1, -1, 0
            elif g != seg:
                seg, place, taken = g, -1, -1
            if i <= place or i <= taken:
                continue
            place = i
            if not stub:
                taken = j
                chosen.append(k)
                orders.append(ord_)
                ord_ += 1
        if chosen:
            rows = batch.take(pa.array(chosen, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(orders, pa.int32()), *rows.columns[5:]], names=["doc_id", "ord", *rows.schema.names[5:]])


def leftmost_longest(ends: DataFrame, *own: str) -> DataFrame:
    """``doc_id, ord, start, stop, text, entities`` of the chosen windows of each document; with ``own`` these columns instead of the entities.

    One shuffle of the terminal windows by document and a pass over them in order.
    """
    own = ("start", "stop", "text", *(own or ("entities",)))
    kinds = [f"{c} {ends.schema[c].dataType.simpleString()}" for c in ("doc_id", *own)]
    rows = ends.select("doc_id", "seg", "i", "j", "is_stub", *own)
    ordered = rows.repartition("doc_id").sortWithinPartitions("doc_id", "seg", "i", F.desc("j"))
    return ordered.mapInArrow(_choose, ", ".join([kinds[0], "ord int", *kinds[1:]]))


def overlapping(ends: DataFrame) -> DataFrame:
    """Every acceptable window, in order of start and falling stop: stubs give none and hide none."""
    window = F.struct("seg", "i", (-F.col("j")).alias("back"), "start", "stop", "text", "entities")
    grouped = ends.where(~F.col("blocked") & ~F.col("is_stub")).groupBy("doc_id").agg(F.array_sort(F.collect_list(window)).alias("w"))
    return grouped.select("doc_id", F.posexplode("w").alias("ord", "m")).select("doc_id", "ord", "m.start", "m.stop", "m.text", "m.entities")


def detected_types(hits: DataFrame, organisms: DataFrame | None = None) -> DataFrame:
    """``doc_id, types``: the taxa of the organisms (type -3) that a document's own leftmost longest mentions name.

    ``organisms`` maps a serial to its taxon; without it the identifier is the taxon. An unknown serial gives none.
    """
    found = leftmost_longest(terminal(hits, F.array(F.lit(-3)))).select("doc_id", F.inline("entities"))
    if organisms is None:
        taxa = found.select("doc_id", F.col("identifier").try_cast("int").alias("taxon"))
    else:
        taxa = found.join(organisms.select("serial", "taxon"), "serial").select("doc_id", "taxon")
    return taxa.where("taxon IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_set("taxon")).alias("types"))


def find_mentions(
    hits: DataFrame, types: tuple[int, ...] = (), auto_detect: bool = False, organisms: DataFrame | None = None, allow_overlap: bool = False, document_types: DataFrame | None = None
) -> DataFrame:
    """``doc_id, ord, start, stop, text, entities``. ``document_types`` (doc_id, types) adds types to single documents.

    With ``auto_detect`` and no requested type, a document that names no organism is searched for all types.
    """
    asked = F.array(*map(F.lit, types)).cast("array<int>")
    for more in ([detected_types(hits, organisms)] if auto_detect else []) + ([document_types] if document_types is not None else []):
        extra = more.select("doc_id", F.col("types").cast("array<int>").alias("more"))
        hits = hits.join(extra, "doc_id", "left")
        found = F.coalesce(F.col("more"), F.array().cast("array<int>"))
        hits = hits.withColumn("types", F.array_union(F.col("types") if "types" in hits.columns else asked, found)).drop("more")
    ends = terminal(hits, F.col("types") if "types" in hits.columns else asked)
    return overlapping(ends) if allow_overlap else leftmost_longest(ends)


def heads_hit(windows: DataFrame, heads: DataFrame) -> DataFrame:
    """Windows that the dictionary has: adds ``is_stub, kinds``, from its ``heads``. The entities stay where they are, and windows keep their key."""
    return windows.join(heads.select("key", "is_stub", "kinds"), "key")


def _ends(hits: DataFrame, types: Column) -> DataFrame:
    """As ``terminal``, for windows with the types of their entities."""
    return hits.where(F.col("is_stub") | (~F.col("blocked") & F.exists("kinds", lambda t: wanted(t, types)))).drop("kinds")


def _asked(types: tuple[int, ...]) -> Column:
    return F.array(*map(F.lit, types)).cast("array<int>")


def found_keys(hits: DataFrame, types: tuple[int, ...] = ()) -> DataFrame:
    """``doc_id, ord, start, stop, text, key``: as ``find_mentions``, with the key that leads to the entities.

    A name may have hundreds of entities, and is named again and again: so they meet a mention when all shuffles by document are over.
    """
    return leftmost_longest(_ends(hits, _asked(types)), "key")


def found_keys_by_organism(hits: DataFrame, rows: DataFrame, organisms: DataFrame, types: tuple[int, ...] = ()) -> DataFrame:
    """As ``found_keys`` with ``types``, those that a document is searched for: the given ones and the taxa of the organisms (type -3) that it names."""
    named = leftmost_longest(_ends(hits, _asked((-3,))), "key").select("doc_id", "key").distinct()
    serials = named.join(rows.where("type = -3").select("key", "serial"), "key")
    taxa = serials.join(organisms.select("serial", "taxon"), "serial").where("taxon IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("taxon").cast("int"))).alias("more"))
    asked = hits.join(taxa, "doc_id", "left").withColumn("types", F.array_union(_asked(types), F.coalesce("more", _asked(())))).drop("more")
    return leftmost_longest(_ends(asked, F.col("types")), "key", "types")


def overlapping_keys(hits: DataFrame, types: tuple[int, ...] = ()) -> DataFrame:
    """``doc_id, start, stop, text, key`` of every acceptable window, in no order."""
    return _ends(hits, _asked(types)).where(~F.col("blocked") & ~F.col("is_stub")).select("doc_id", "start", "stop", "text", "key")


def keyed_rows(found: DataFrame, rows: DataFrame, types: tuple[int, ...] = ()) -> DataFrame:
    """One row for each mention with its key and each wanted entity, from the ``rows`` of the dictionary; a mention's own ``types`` count, if it has them."""
    asked = F.col("types") if "types" in found.columns else _asked(types)
    return found.join(rows.select("key", "type", "serial", "identifier"), "key").where(wanted(F.col("type"), asked)).drop("key", "types")


def with_entities(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Mentions with ``entities`` in place of their key, from the ``rows`` of the dictionary, which are of the wanted types."""
    return found.join(entities_by_key(rows), "key").drop("key")


def mention_rows(matches: DataFrame) -> DataFrame:
    """One row for each mention and entity: ``doc_id, ord, start, stop, text, type, serial, identifier``."""
    return matches.select("doc_id", "ord", "start", "stop", "text", F.inline("entities"))
