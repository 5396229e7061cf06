"""Dictionary tables: names with their entities, stop lists, stubs, edits and lookups.

A dictionary is ``key, name, entities`` with ``entities`` an array of (type, serial, identifier). A stub is an entity
without serial and identifier that a stop list brings in: a hit on it ends the search at its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.keys import canonical_key
from termloom.functions.latin import leading_integer

ENTITY = "struct<type:int,serial:bigint,identifier:string>"


def _last(df: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """The last row of each key by the column ``order``; without one, as rows of a table have no order, the largest values."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*([F.col(order)] if order else []), *(F.col(c) for c in rest if c != order))
    return df.groupBy(*keys).agg(F.max(by).alias("_l")).select(*keys, *(F.col(f"_l.{c}") for c in rest))


def entity_types(entities: DataFrame, order: str | None = None) -> DataFrame:
    """``serial, type``: the last row of a serial counts."""
    cols = ["serial", "type", *([order] if order else [])]
    return _last(entities.select(*cols).where("serial IS NOT NULL"), ["serial"], order).select("serial", "type")


def names_with_entities(names: DataFrame, entities: DataFrame, order: str | None = None) -> DataFrame:
    """``key, name, type, serial, identifier`` of all names whose serial is an entity, once for each key and serial.

    Rows with a null serial, name or type, and names without any letter-like byte, are left out. ``order``: a column of both tables that tells
    which of several rows is the first name and the last entity.
    """
    known = _last(entities.where("serial IS NOT NULL AND type IS NOT NULL"), ["serial"], order).select("serial", "type", "identifier")
    keyed = names.where("serial IS NOT NULL AND name IS NOT NULL").withColumn("key", canonical_key(F.col("name"))).where("name <> ''")
    by = F.struct(*([F.col(order)] if order else []), F.col("name"))
    first = keyed.groupBy("key", "serial").agg(F.min_by("name", by).alias("name"))
    return first.join(known, "serial").select("key", "name", "type", "serial", "identifier")


def names_of_type(names: DataFrame, entity_type: int) -> DataFrame:
    """``names_with_entities`` for a list of names that all have one type."""
    keyed = names.where("serial IS NOT NULL AND name IS NOT NULL AND name <> ''").withColumn("key", canonical_key(F.col("name")))
    first = keyed.groupBy("key", "serial").agg(F.min("name").alias("name"))
    return first.select("key", "name", F.lit(entity_type).cast("int").alias("type"), "serial", F.lit(None).cast("string").alias("identifier"))


def stub_names(rows: DataFrame, stop_global: DataFrame) -> DataFrame:
    """The names of a stop list that the dictionary lacks, whatever their flag, as rows without an entity."""
    listed = stop_global.where("name IS NOT NULL").withColumn("key", canonical_key(F.col("name"))).groupBy("key").agg(F.min("name").alias("name"))
    new = listed.join(rows.select("key").distinct(), "key", "left_anti")
    return new.select("key", "name", F.lit(0).alias("type"), F.lit(None).cast("bigint").alias("serial"), F.lit(None).cast("string").alias("identifier"))


def dictionary(rows: DataFrame, stop_global: DataFrame | None = None) -> DataFrame:
    """``key, name, is_stub, entities`` from rows of names and, where given, the stubs of a stop list."""
    if stop_global is not None:
        rows = rows.unionByName(stub_names(rows, stop_global))
    entity = F.struct(F.col("type").cast("int").alias("type"), F.col("serial").cast("bigint").alias("serial"), "identifier")
    grouped = rows.groupBy("key").agg(F.min("name").alias("name"), F.array_sort(F.collect_set(entity)).alias("entities"))
    only = F.col("entities")[0]
    stub = (F.size("entities") == 1) & F.coalesce(only["serial"], F.lit(0)).eqNullSafe(0) & only["identifier"].isNull()
    return grouped.select("key", "name", stub.alias("is_stub"), "entities")


def heads(rows: DataFrame, stop_global: DataFrame | None = None) -> DataFrame:
    """``key, name, is_stub, kinds``: as ``dictionary``, with the types of the entities alone."""
    if stop_global is not None:
        rows = rows.unionByName(stub_names(rows, stop_global))
    n, serial, identifier = F.count("*").alias("n"), F.max("serial").alias("serial"), F.max("identifier").alias("identifier")
    grouped = rows.groupBy("key").agg(F.min("name").alias("name"), n, serial, identifier, F.array_sort(F.collect_set(F.col("type").cast("int"))).alias("kinds"))
    stub = (F.col("n") == 1) & (F.coalesce("serial", F.lit(0)) == 0) & F.col("identifier").isNull()
    return grouped.select("key", "name", stub.alias("is_stub"), "kinds")


def entities_by_key(rows: DataFrame) -> DataFrame:
    """``key, entities``, from the rows of the dictionary, which are shuffled one by one, as lists of them are larger."""
    entity = F.struct(F.col("type").cast("int").alias("type"), F.col("serial").cast("bigint").alias("serial"), "identifier")
    return rows.repartition("key").groupBy("key").agg(F.array_sort(F.collect_set(entity)).alias("entities"))


def flag_is_set(flag: Column) -> Column:
    return F.coalesce(F.left(flag, F.lit(1)).isin("1", "t", "y"), F.lit(False))


def stop_list(rows: DataFrame, order: str | None = None, local: bool = False) -> DataFrame:
    """``name[, doc_id], blocked``: the last row of a name, in a local list of a name and document."""
    keys = ["name", "doc_id"] if local else ["name"]
    return _last(rows.where("name IS NOT NULL"), keys, order).select(*keys, flag_is_set(F.col("flag")).alias("blocked"))


def resolve_names(queries: DataFrame, words: DataFrame) -> DataFrame:
    """``name, type, serial, identifier`` of each name that the dictionary knows, whatever its spelling."""
    hits = queries.where("name IS NOT NULL").withColumn("key", canonical_key(F.col("name"))).join(words.where("NOT is_stub").select("key", "entities"), "key")
    return hits.select("name", F.inline("entities")).distinct()


def has_names(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``queries`` (name, type, serial) that the dictionary has."""
    asked = queries.withColumn("key", canonical_key(F.col("name")))
    return asked.join(rows.select("key", "type", "serial"), ["key", "type", "serial"], "left_semi").drop("key")


def add_names(rows: DataFrame, new: DataFrame) -> DataFrame:
    """``rows`` with new (name, type, serial, identifier); what is there already stays once."""
    keyed = new.select(canonical_key(F.col("name")).alias("key"), "name", F.col("type").cast("int"), F.col("serial").cast("bigint"), "identifier")
    missing = keyed.dropDuplicates(["key", "type", "serial", "identifier"]).join(
        rows.select("key", "type", F.col("serial").alias("s"), F.col("identifier").alias("d")),
        (keyed.key == rows.key) & (keyed.type == rows.type) & F.col("s").eqNullSafe(keyed.serial) & F.col("d").eqNullSafe(keyed.identifier),
        "left_anti",
    )
    return rows.unionByName(missing)


def promoted_blocks(blocks: DataFrame, documents: int = 5) -> DataFrame:
    """``name, blocked`` of the names blocked in at least so many documents: blocked everywhere."""
    counts = blocks.where("name IS NOT NULL AND doc_id IS NOT NULL").groupBy("name").agg(F.countDistinct("doc_id").alias("n"))
    return counts.where(F.col("n") >= documents).select("name", F.lit(True).alias("blocked"))


def edited(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(local stop list, global stop list) after the actions of a change log, in order.

    ``log`` has ``at, action, name, doc_id``; AllowName and BlockName set a name of a document, the last one counts, or,
    without a document, of all documents. A name that was blocked in five documents is blocked everywhere from then on.
    """
    acts = log.where("action IN ('AllowName', 'BlockName') AND name IS NOT NULL").withColumn("doc_id", F.nullif("doc_id", F.lit("")))
    last = F.max_by("action", F.struct("at", "action"))
    local = acts.where("doc_id IS NOT NULL").groupBy("name", "doc_id").agg((last == "BlockName").alias("blocked"))
    # The fifth document that blocks a name blocks it everywhere at that time; a later word on all documents counts more.
    first = acts.where("action = 'BlockName' AND doc_id IS NOT NULL").groupBy("name", "doc_id").agg(F.min("at").alias("at"))
    numbered = first.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("at", "doc_id")))
    promoted = numbered.where("n = 5").select("at", F.lit("BlockName").alias("action"), "name")
    everywhere = acts.where("doc_id IS NULL").select("at", "action", "name").unionByName(promoted)
    return local, everywhere.groupBy("name").agg((last == "BlockName").alias("blocked"))


def added_names(log: DataFrame) -> DataFrame:
    """``name, type, serial, identifier`` of the AddName actions of a change log (``name, doc_id`` and ``identifier`` as the log's
    fields stand: name, type, identifier). An identifier in digits is a serial too."""
    adds = log.where("action = 'AddName' AND name IS NOT NULL")
    kind = leading_integer(F.col("doc_id"), "int")
    return adds.select("name", kind.alias("type"), F.col("identifier").try_cast("bigint").alias("serial"), "identifier").distinct()


def replayed(rows: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dictionary rows, local stop list, global stop list) after a change log: names added, allowed and blocked."""
    return (add_names(rows, added_names(log)), *edited(log))


# Types whose names no conflict removes, types besides the non-negative ones that conflict with others, sizes of families.
PROTECTED_TYPES = (-2, -3, -21, -22, -23, -25, -26, -27)
CONFLICT_TYPES = (-2, -22, -25, -26, -27)
LARGE_FAMILY, LOCAL_FAMILY = 1000, 20


def cleaning_log(rows: DataFrame) -> DataFrame:
    """``reason, key, name, type, serial, count, masked_type, masked_serial`` of the names to remove from a dictionary.

    CONFLICT: another entity of the name masks it, a row for each. FAMILY-GLOBAL: the name's largest count in a type from
    0 is a large family. FAMILY-LOCAL: its own type's count is one. SHORT-NAME: a single byte. SHORT-WIKI: type -11, 3 bytes.
    """
    by_type, by_key = Window.partitionBy("key", "type"), Window.partitionBy("key")
    counted = rows.select("key", F.min("name").over(by_key).alias("name"), "type", "serial", F.count("*").over(by_type).cast("int").alias("count"))
    counted = counted.withColumn("largest", F.max(F.when(F.col("type") >= 0, F.col("count"))).over(by_key))
    none = [F.lit(None).cast("int").alias("masked_type"), F.lit(None).cast("bigint").alias("masked_serial")]
    size = F.length(F.encode("name", "UTF-8"))
    large = F.coalesce(F.col("largest") >= LARGE_FAMILY, F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(large, "FAMILY-GLOBAL").when(F.col("count") > LOCAL_FAMILY, "FAMILY-LOCAL"),
            F.when(size < 2, "SHORT-NAME"),
            F.when((F.col("type") == -11) & (size <= 3), "SHORT-WIKI"),
        )
    )
    simple = counted.select(F.explode(reasons).alias("reason"), "key", "name", "type", "serial", "count", *none)
    mask = rows.where((F.col("type") >= 0) | F.col("type").isin(*CONFLICT_TYPES)).select("key", F.col("type").alias("masked_type"), F.col("serial").alias("masked_serial"))
    conflicts = (
        counted.where(~F.col("type").isin(*PROTECTED_TYPES))
        .join(mask, "key")
        .where((F.col("type") != F.col("masked_type")) & ((F.col("type") < 0) | (F.col("masked_type") < 0)))
        .select(F.lit("CONFLICT").alias("reason"), "key", "name", "type", "serial", "count", "masked_type", "masked_serial")
    )
    return conflicts.unionByName(simple)


def cleaned_names(names: DataFrame, log: DataFrame) -> DataFrame:
    """The rows of ``names`` (serial, name) that the log doesn't remove; repeated rows stay."""
    removed = log.select("serial", "key").distinct()
    return names.withColumn("key", canonical_key(F.col("name"))).join(removed, ["serial", "key"], "left_anti").drop("key")
