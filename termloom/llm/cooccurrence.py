"""Items that appear together in a record, counted by stripes, with the log-likelihood ratio against chance.

Each task turns the item lists of its records into stripes: for an item, the array of the items behind it in the order
of ids that share a record with it, with counts. Stripes are combined in the task before they are shuffled, and arrays
of one key are merged in sorted streams: a task holds one open stripe, not a group. The stripe of an item in very many
records is split by the neighbour into parts that are merged apart, so that no task gets all of a hot item.

A record of more than ``BLOCK`` items is cut into blocks by the hash of the item; all pairs of its blocks are processed
as rows of their own, wherever they fall, so that no list and no task grows with the record and every pair is counted.

Items of fewer records than the least count of a pair can't be in a result and are left out before pairing.

Defined results: items are a set per record (repeated rows count once); null records and null items are left out;
record ids of any type, items are bigint; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.sources.staging import checkpointed

BLOCK = 256
#: An item in more records than this has its stripe split into parts, as many as it takes.
RECORDS_PER_PART = 20_000
#: An item with more than this share of all rows is hot. There are at most 1 / HOT_SHARE of them, so they can be broadcast.
HOT_SHARE = 0.0001
#: The level of the log-likelihood ratio from which a pair is significant: 0.1 % of pairs without any relation reach it (chi-square, one degree of freedom).
SIGNIFICANT = 10.828
#: Pairs that are expanded at once, entries held before a task emits its stripes, and entries of one emitted row.
PAIRS_AT_ONCE, HELD_ENTRIES, ROW_ENTRIES = 2_000_000, 3_000_000, 256

STRIPES = "item bigint, part int, n1 bigint, neighbours array<bigint>, n2 array<bigint>, counts array<bigint>"


def _sum_up(entries: np.ndarray) -> np.ndarray:
    """Entries (item, n1, neighbour, n2, count) as columns, with equal pairs added up, in order."""
    if not entries.shape[1]:
        return entries
    entries = entries[:, np.lexsort((entries[2], entries[0]))]
    new = np.concatenate([[True], (np.diff(entries[0]) != 0) | (np.diff(entries[2]) != 0)])
    at = np.flatnonzero(new)
    out = entries[:, at]
    out[4] = np.add.reduceat(entries[4], at)
    return out


def _expand(items: list[np.ndarray], counts: list[np.ndarray], others: list[np.ndarray | None], other_counts: list) -> Iterator[np.ndarray]:
    """The pairs of some records as entries. Records of equal size are expanded together."""
    sizes = np.array([len(x) for x in items])
    single = np.array([o is None for o in others], bool)
    for m in np.unique(sizes[single]):
        rows = np.flatnonzero(single & (sizes == m))
        if m < 2:
            continue
        a, b = np.triu_indices(int(m), 1)
        step = max(1, PAIRS_AT_ONCE // len(a))
        for part in (rows[i : i + step] for i in range(0, len(rows), step)):
            x, c = np.stack([items[i] for i in part]), np.stack([counts[i] for i in part])
            order = np.argsort(x, 1)
            x, c = np.take_along_axis(x, order, 1), np.take_along_axis(c, order, 1)
            yield np.stack([x[:, a].ravel(), c[:, a].ravel(), x[:, b].ravel(), c[:, b].ravel(), np.ones(len(part) * len(a), np.int64)])
    for i in np.flatnonzero(~single):
        x, y = np.repeat(items[i], len(others[i])), np.tile(others[i], len(items[i]))
        cx, cy = np.repeat(counts[i], len(others[i])), np.tile(other_counts[i], len(items[i]))
        swap = x > y
        yield np.stack([np.where(swap, y, x), np.where(swap, cy, cx), np.where(swap, x, y), np.where(swap, cx, cy), np.ones(len(x), np.int64)])


def _part_of(n1: np.ndarray, neighbour: np.ndarray) -> np.ndarray:
    parts = np.maximum(-(-n1 // RECORDS_PER_PART), 1)
    return ((neighbour.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % parts


def _stripes(entries: np.ndarray, least: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows of stripes from entries that are added up, arrays of ``ROW_ENTRIES`` at most."""
    entries = entries[:, entries[4] >= least]
    if not entries.shape[1]:
        return
    part = _part_of(entries[1], entries[2])
    order = np.lexsort((entries[2], part, entries[0]))
    entries, part = entries[:, order], part[order]
    new = np.concatenate([[True], (np.diff(entries[0]) != 0) | (np.diff(part) != 0)])
    first = np.flatnonzero(new)
    rank = np.arange(len(part)) - np.repeat(first, np.diff(np.append(first, len(part))))
    cut = np.flatnonzero(rank % ROW_ENTRIES == 0)
    for k in range(0, len(cut), 4096):
        at = cut[k : k + 4096]
        end = cut[k + 4096] if k + 4096 < len(cut) else len(part)
        offsets = pa.array(np.append(at, end) - at[0], pa.int32())
        arrays = [pa.ListArray.from_arrays(offsets, pa.array(entries[i, at[0] : end])) for i in (2, 3, 4)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(entries[0, at]), pa.array(part[at].astype(np.int32)), pa.array(entries[1, at]), *arrays],
            names=["item", "part", "n1", "neighbours", "n2", "counts"],
        )


def _lists(column: pa.Array) -> list:
    offsets, values = column.offsets.to_numpy(), column.flatten().to_numpy()
    offsets = offsets - offsets[0]
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [values[a:b] if v else None for a, b, v in zip(offsets[:-1], offsets[1:], valid)]


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        for entries in _expand(*(_lists(batch.column(i)) for i in range(4))):
            held.append(_sum_up(entries))
            size += held[-1].shape[1]
            if size > HELD_ENTRIES:
                held = [_sum_up(np.concatenate(held, 1))]
                size = held[0].shape[1]
                if size > HELD_ENTRIES // 2:
                    yield from _stripes(held[0])
                    held, size = [], 0
    if held:
        yield from _stripes(_sum_up(np.concatenate(held, 1)))


def _merge(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Merge arrays of equal (item, part) from rows sorted by it. The last key of a batch stays open."""
        rest = np.zeros((5, 0), np.int64)
        last: tuple[int, int] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.diff(batch.column(3).offsets.to_numpy())
            item, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.stack([np.repeat(item, size), np.repeat(batch.column(2).to_numpy(), size), *(batch.column(i).flatten().to_numpy() for i in (3, 4, 5))])
            key = (int(item[-1]), int(part[-1]))
            open_ = np.repeat((item == key[0]) & (part == key[1]), size)
            if last == key:
                rest = _sum_up(np.concatenate([rest, new[:, open_]], 1))
                continue
            yield from _stripes(_sum_up(np.concatenate([rest, new[:, ~open_]], 1)), least)
            rest, last = _sum_up(new[:, open_]), key
        yield from _stripes(rest, least)

    return run


def record_items(items: DataFrame, record: str, item: str) -> DataFrame:
    """``record, item``: the items of each record once, kept: read for the numbers of records, and by hot and other items."""
    pairs = items.select(F.col(record).alias("record"), F.col(item).cast("bigint").alias("item")).where("record IS NOT NULL AND item IS NOT NULL")
    return checkpointed(pairs.distinct())


def stripes(pairs: DataFrame, least_records: int = 1, least_together: int = 1) -> DataFrame:
    """``item, part, n1, neighbours, n2, counts``: merged stripes of ``record_items``; a neighbour's id is above its item's.

    ``n1`` and ``n2`` are the numbers of records of the item and of each neighbour.
    """
    known = pairs.groupBy("item").agg(F.count("*").alias("n1"))
    most = known.select(F.sum("n1") * HOT_SHARE).scalar()
    # The rows of hot items meet a broadcast table where they are; only those of the others are shuffled by item.
    hot = F.broadcast(known.where((F.col("n1") > most) & (F.col("n1") >= least_records)))
    few = known.where((F.col("n1") <= most) & (F.col("n1") >= least_records))
    cold = pairs.join(F.broadcast(known.where(F.col("n1") > most).select("item")), "item", "left_anti")
    # Used five times below: kept, so that it is computed once.
    kept = checkpointed(pairs.join(hot, "item").unionByName(cold.join(few, "item")))
    large = kept.groupBy("record").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    entry = F.collect_list(F.struct("item", "n1")).alias("list")
    none = F.lit(None).cast("array<bigint>")
    whole = kept.join(large, "record", "left_anti").groupBy("record").agg(entry)
    blocks = (
        kept.join(large, "record")
        .withColumn("block", F.pmod(F.xxhash64("item"), F.ceil(F.col("size") / BLOCK)))
        .groupBy("record", "block")
        .agg(entry)
    )
    inside = whole.select("list").unionByName(blocks.select("list")).select("list.item", "list.n1", none.alias("other"), none.alias("other_n1"))
    other = blocks.select("record", F.col("block").alias("other_block"), F.col("list").alias("other_list"))
    across = (
        blocks.join(other, "record")
        .where(F.col("block") < F.col("other_block"))
        .select("list.item", "list.n1", F.col("other_list.item").alias("other"), F.col("other_list.n1").alias("other_n1"))
    )
    lists = inside.unionByName(across)
    return (
        lists.mapInArrow(_map, STRIPES)
        .repartition("item", "part")
        .sortWithinPartitions("item", "part")
        .mapInArrow(_merge(least_together), STRIPES)
    )


def judged_pairs(items: DataFrame, record: str, item: str, least_together: int = 5) -> DataFrame:
    """``item1, item2, n12, n1, n2, n, lift, llr, significant`` of all pairs together in at least ``least_together`` records.

    ``n`` counts the records with any item. ``lift`` is n12 * n / (n1 * n2), ``llr`` the log-likelihood ratio of the
    two-by-two table. A pair is ``significant`` if it is together more often than by chance and its ratio reaches ``SIGNIFICANT``.
    """
    pairs = record_items(items, record, item)
    n = pairs.select(F.countDistinct("record")).scalar()
    flat = (
        stripes(pairs, least_together, least_together)
        .select("item", "n1", F.inline(F.arrays_zip("neighbours", "n2", "counts")))
        .select(F.col("item").alias("item1"), F.col("neighbours").alias("item2"), F.col("counts").alias("n12"), "n1", "n2", n.alias("n"))
    )
    x_log_x = lambda x: F.when(x > 0, x * F.log(x.cast("double"))).otherwise(F.lit(0.0))
    n, n1, n2, n12 = (F.col(c) for c in ("n", "n1", "n2", "n12"))
    llr = 2 * (
        x_log_x(n12) + x_log_x(n1 - n12) + x_log_x(n2 - n12) + x_log_x(n - n1 - n2 + n12)
        - x_log_x(n1) - x_log_x(n - n1) - x_log_x(n2) - x_log_x(n - n2) + x_log_x(n)
    )
    judged = flat.withColumn("lift", n12.cast("double") * n / n1 / n2).withColumn("llr", llr)
    return judged.withColumn("significant", (F.col("lift") > 1) & (F.col("llr") >= SIGNIFICANT))


def above_chance(pairs: DataFrame, factor: int) -> DataFrame:
    """The pairs at least ``factor`` times as often together as by chance: exact, in whole numbers of 38 digits."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    return pairs.where(big("n12") * big("n") >= F.lit(factor) * big("n1") * big("n2"))
