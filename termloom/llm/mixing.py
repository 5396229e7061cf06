"""Mixing sources to target weights under a cap on repeats, by budgets on a tree.

The tree's levels run from the kind of text over the language to the site. Targets weigh its top; below, a node's
weight is its number of tokens to a power, so that a power under 1 lifts small languages. Weights go down the tree as
shares of the parent. Budgets go down too: a node's budget is shared among its children by weight, and what a child
can't take up (its tokens times the permitted repeats) goes to its siblings, by weight again. Since no node gets
more than its subtree can take, shortages are settled among siblings before they reach an ancestor.

The total is by default the largest at which every source present can have its target share in full.

Budgets are shared without a window over all children of a node: children are summed by capacity per weight in ranges,
running sums go over the ranges, and inside of a range over its distinct values, so that a language with all sites of a
crawl is spread over the cluster.

A leaf takes whole epochs, each document once in each, and of one more epoch, put in order by a seeded hash, the prefix
of documents whose tokens fit into the rest of the budget. The prefix is found by sums over ranges of the hash, so that
a leaf with a third of all rows is never sorted by one task: only the documents of the one range that the border
falls into are. The documents that the budgets of leaves end inside of fill the lack of their siblings, then of their source.

Defined results: a null source, or one without a target, isn't used; documents without tokens aren't used; a null
language counts as ``und`` and languages are compared in lower case; a null site is a site of its own. A target
without tokens gives its share to the others. Document ids are taken as they are: two rows with one id are two documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.sources.staging import checkpointed

LEVELS = ("source", "lang", "site")
#: Exponent of the tokens as weight, by level below the top.
POWERS = {"lang": 0.7, "site": 1.0}
#: Ranges of the hash in which a leaf's tokens are summed, as a power of two.
RANGE_BITS = 12
#: A leaf with more than this share of all tokens is hot. There are at most 1 / HOT_SHARE of them, so they can be broadcast.
HOT_SHARE = 0.001
#: Ranges of capacity per weight for each doubling of it.
STEPS = 16


def _null_safe(level: str) -> Column:
    return F.coalesce(F.col(level), F.lit("")).alias(level)


def sized(documents: DataFrame, tokens: str = "n_tokens") -> DataFrame:
    """``doc_id, source, lang, site, n_tokens`` with normal forms of the levels."""
    lang = F.coalesce(F.lower(F.col("lang")), F.lit("und")).alias("lang")
    return documents.select("doc_id", "source", lang, _null_safe("site"), F.col(tokens).alias("n_tokens"))


def _budget(full: Column) -> Column:
    """Full nodes take their capacity, the open ones what is left (parent_budget - spent) by their weights."""
    left = F.greatest(F.lit(0.0), F.col("parent_budget") - F.col("spent"))
    return F.when(full, F.col("capacity")).otherwise(F.least(F.col("capacity"), F.col("weight") * left / F.col("open_weight")))


def _is_full(before: Column, from_here: Column) -> Column:
    """With the nodes in order of capacity per weight (``level``), a node is full exactly if raising all open nodes to its level still fits the budget.

    The budget is at most all capacity; sums in another order may be off by a rounding.
    """
    return before + F.col("level") * from_here <= F.col("parent_budget") * (1 + 1e-12)


def _share_few(nodes: DataFrame, parent: tuple[str, ...]) -> DataFrame:
    """Adds ``budget`` to nodes (weight, capacity, parent_budget): the parent's budget by weight, no node above its capacity.

    For children that are sources or languages: a window holds as many rows as there are of these.
    """
    nodes = nodes.withColumn("level", F.col("capacity") / F.col("weight"))
    w = Window.partitionBy(*(parent or (F.lit(1),)))
    ties = [x for x in LEVELS if x in nodes.columns]
    up = w.orderBy(F.asc("level"), *map(F.asc, ties)).rowsBetween(Window.unboundedPreceding, -1)
    down = w.orderBy(F.desc("level"), *map(F.desc, ties)).rowsBetween(Window.unboundedPreceding, 0)
    full = _is_full(F.coalesce(F.sum("capacity").over(up), F.lit(0.0)), F.sum("weight").over(down))
    return (
        nodes.withColumn("full", full)
        .withColumn("spent", F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0.0)).over(w))
        .withColumn("open_weight", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(w))
        .withColumn("budget", _budget(F.col("full")))
        .drop("level", "full", "spent", "open_weight")
    )


def _share_many(nodes: DataFrame, parent: tuple[str, ...]) -> DataFrame:
    """The same for any number of children: a parent has one highest level of full nodes, found on sums by ranges of the level and by its distinct values in a range."""
    keys = list(parent)
    nodes = nodes.withColumn("level", F.col("capacity") / F.col("weight"))
    sums = F.sum("capacity").alias("capacity"), F.sum("weight").alias("weight"), F.first("parent_budget").alias("parent_budget")
    levels = nodes.groupBy(*keys, F.floor(F.log2("level") * STEPS).alias("range"), "level").agg(*sums)
    ranges = levels.groupBy(*keys, "range").agg(*sums[:2])
    up, down = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("range"), F.desc("range")))
    bounds = ranges.select(*keys, "range", F.coalesce(F.sum("capacity").over(up), F.lit(0.0)).alias("before"), F.coalesce(F.sum("weight").over(down), F.lit(0.0)).alias("after"))
    up, down = (Window.partitionBy(*keys, "range").orderBy(o) for o in (F.asc("level"), F.desc("level")))
    before = F.col("before") + F.coalesce(F.sum("capacity").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    from_here = F.col("after") + F.sum("weight").over(down.rowsBetween(Window.unboundedPreceding, 0))
    judged = levels.join(bounds, [*keys, "range"]).withColumn("full", _is_full(before, from_here))
    # A row for each parent, kept.
    borders = checkpointed(judged.groupBy(*keys).agg(
        F.max(F.when(F.col("full"), F.col("level"))).alias("upto"),
        F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0.0)).alias("spent"),
        F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).alias("open_weight"),
    ))
    shared = nodes.join(borders, keys).withColumn("budget", _budget(F.col("upto").isNotNull() & (F.col("level") <= F.col("upto"))))
    return shared.drop("level", "upto", "spent", "open_weight")


def budgets(documents: DataFrame, targets: DataFrame, total: float | None = None, powers: dict[str, float] = POWERS) -> DataFrame:
    """``source, lang, site, tokens, max_repeats, capacity, budget`` of each leaf.

    ``documents`` as ``sized`` gives them; ``targets`` has ``source, target_share, max_repeats``, a row for each source.
    """
    goals = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).where(
        "source IS NOT NULL AND target_share > 0 AND max_repeats > 0"
    )
    leaves = (
        documents.where("n_tokens > 0 AND source IS NOT NULL")
        .groupBy(*LEVELS)
        .agg(F.sum("n_tokens").cast("double").alias("tokens"))
        .join(goals, "source")
        .withColumn("capacity", F.col("tokens") * F.col("max_repeats"))
    )
    # A row for each leaf, read at every level of the tree: kept, so that the documents are summed once.
    leaves = checkpointed(leaves)
    nodes = leaves.groupBy("source").agg(F.sum("capacity").alias("capacity"), F.first("target_share").alias("weight"))
    everything = Window.partitionBy(F.lit(1))  # as many rows as targets
    nodes = nodes.withColumn("weight", F.col("weight") / F.sum("weight").over(everything))
    most = F.min(F.col("capacity") / F.col("weight")).over(everything)
    nodes = nodes.withColumn("parent_budget", most if total is None else F.least(F.lit(float(total)), F.sum("capacity").over(everything)))
    nodes = _share_few(nodes, ()).select("source", F.col("budget").alias("parent_budget"))
    for depth in range(1, len(LEVELS)):
        keys, parent = LEVELS[: depth + 1], LEVELS[:depth]
        own = (
            leaves.groupBy(*keys)
            .agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
            .withColumn("weight", F.pow("tokens", F.lit(powers[LEVELS[depth]])))
            .join(nodes, list(parent))
        )
        nodes = (_share_few if depth == 1 else _share_many)(own, parent).select(*keys, F.col("budget").alias("parent_budget"))
    full = leaves.join(nodes.withColumnRenamed("parent_budget", "budget"), list(LEVELS))
    return checkpointed(full.select(*LEVELS, "tokens", "max_repeats", "capacity", "budget"))


def _running(rows: DataFrame, keys: tuple[str, ...], value: str, name: str) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over the rows of ``keys`` up to this one in order of ``place, doc_id``.

    Over ranges of the place first, at most 2 ** RANGE_BITS for each key, then over the rows of a range.
    """
    ranges = rows.groupBy(*keys, "range").agg(F.sum(value).alias("_in"))
    w = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select(*keys, "range", F.coalesce(F.sum("_in").over(w), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "range").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(before, [*keys, "range"]).withColumn(name, F.col("_before") + F.sum(value).over(inside)).drop("_before")


def _fill(borders: DataFrame) -> DataFrame:
    """Adds ``more`` to the documents that a leaf's budget ends inside of, one at most for each leaf.

    What the leaves lack together (``short``) is filled with whole documents among the leaves of a language, and what
    is lacking then among all of the source, so that a source misses its budget by less than a document.
    """
    borders = borders.withColumn("more", F.lit(0))
    for level in range(len(LEVELS) - 1, 0, -1):
        keys = LEVELS[:level]
        # At most a row for each leaf, read three times: kept.
        borders = checkpointed(borders.withColumn("wanted", F.when(F.col("more") == 0, F.col("n_tokens")).otherwise(0)))
        lacks = borders.groupBy(*keys).agg(F.sum("short").alias("lack"))
        summed = _running(borders, keys, "wanted", "upto_here").join(lacks, list(keys))
        taken = (F.col("more") == 0) & (F.col("upto_here") <= F.col("lack"))
        borders = (
            summed.withColumn("taken", taken)
            .withColumn("more", F.when(F.col("taken"), 1).otherwise(F.col("more")))
            .withColumn("short", F.col("short") - F.when(F.col("taken"), F.col("n_tokens")).otherwise(0))
            .drop("taken", "wanted", "upto_here", "lack")
        )
    return borders


def select_documents(documents: DataFrame, leaves: DataFrame, seed: int = 7) -> DataFrame:
    """``doc_id, source, lang, site, n_tokens, times_used`` of the documents used at least once.

    ``times_used`` never exceeds ``max_repeats``.
    """
    epochs = F.least(F.floor(F.col("budget") / F.col("tokens") + 1e-9), F.col("max_repeats")).cast("int")
    plan = leaves.select(*LEVELS, epochs.alias("epochs"), "max_repeats", "budget", "tokens")
    rest = F.when(F.col("epochs") < F.col("max_repeats"), F.greatest(F.col("budget") - F.col("epochs") * F.col("tokens"), F.lit(0.0))).otherwise(0.0)
    plan = plan.select(*LEVELS, "epochs", "tokens", rest.alias("rest"))
    most = plan.select(F.sum("tokens") * HOT_SHARE).scalar()
    hot = F.broadcast(plan.where(F.col("tokens") > most))
    usable = documents.where("n_tokens > 0 AND source IS NOT NULL")
    # Documents of hot leaves stay where they are; only those of the others are shuffled by leaf.
    cold = usable.join(hot.select(*LEVELS), list(LEVELS), "left_anti").join(plan.where(F.col("tokens") <= most), list(LEVELS))
    placed = (
        usable.join(hot, list(LEVELS))
        .unionByName(cold)
        .drop("tokens")
        .withColumn("place", F.xxhash64("doc_id", F.lit(seed), "epochs"))
        .withColumn("range", F.shiftrightunsigned("place", 64 - RANGE_BITS))
    )
    by_range = Window.partitionBy(*LEVELS).orderBy("range")  # at most 2 ** RANGE_BITS rows a leaf
    ranges = (
        placed.where("rest > 0")
        .groupBy(*LEVELS, "range")
        .agg(F.sum("n_tokens").alias("range_tokens"))
        .withColumn("upto", F.sum("range_tokens").over(by_range))
        .withColumn("before", F.col("upto") - F.col("range_tokens"))
        .drop("range_tokens")
    )
    known = placed.join(ranges, [*LEVELS, "range"], "left")
    # Only the range that the border falls into needs the order of its documents.
    inside = F.col("before").isNotNull() & (F.col("before") < F.col("rest")) & (F.col("upto") > F.col("rest"))
    border = Window.partitionBy(*LEVELS, "range").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    ordered = known.where(inside).withColumn("sum", F.col("before") + F.sum("n_tokens").over(border))
    split = (F.col("sum") > F.col("rest")) & (F.col("sum") - F.col("n_tokens") < F.col("rest"))
    plain = ordered.where(~split).withColumn("more", (F.col("sum") <= F.col("rest")).cast("int")).drop("sum")
    filled = _fill(ordered.where(split).withColumn("short", F.col("rest") - (F.col("sum") - F.col("n_tokens"))).drop("sum")).drop("short")
    chosen = known.where(~inside).withColumn("more", (F.col("upto") <= F.col("rest")).cast("int")).unionByName(plain).unionByName(filled)
    return (
        chosen.withColumn("times_used", F.col("epochs") + F.coalesce("more", F.lit(0)))
        .where("times_used > 0")
        .select("doc_id", *LEVELS, "n_tokens", "times_used")
    )


def reached_shares(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, n_documents, most_used, tokens, share`` of each target: what came out."""
    sums = selected.groupBy("source").agg(
        F.count("*").alias("n_documents"), F.max("times_used").alias("most_used"), F.sum(F.col("n_tokens") * F.col("times_used")).alias("tokens")
    )
    out = targets.join(sums, "source", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    return out.select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
        F.coalesce("most_used", F.lit(0)).alias("most_used"),
        tokens.alias("tokens"),
        F.round(tokens / F.sum(tokens).over(Window.partitionBy(F.lit(1))), 6).alias("share"),
    )
