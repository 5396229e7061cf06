"""Occurrences and records of every n-gram, from suffix arrays with common-prefix intervals.

A record's text is a list of words; its suffixes, cut at ``longest`` words if that is given, are sorted. N-grams are the intervals
of the sorted suffixes whose neighbours have a common prefix of n words: the length of an interval is the number of
occurrences, and an interval's length less its duplicate adjacencies (the places at which the record, in the order of
records inside of the interval, is the record before) is the number of records.

Suffixes are spread over the cluster by record and first word, so that neither a frequent word nor a record with a third
of all rows falls to one task, and equal suffixes of a record are counted before that. All occurrences of an n-gram in a
record share both keys, so the numbers of the parts add up. Spark sorts each part (spilling to disk), and arrays of a
bounded number of suffixes are taken from it at borders between keys.

Defined results: null and empty texts have no words; a null record is left out; repeated rows count again as occurrences,
not as records; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffixes sorted as one array. A key with more, which then are distinct suffixes of one record, is one array all the same.
ARRAY = 100_000
#: Stands between the words of an n-gram while it is a key; words never hold it, as they are split at white space.
GLUE = "\n"

COUNTS = "ngram string, n int, occurrences bigint, records bigint"

WHITE_SPACE = r"[\t-\r \u0085   -     　\u001C-\u001F]+"
EDGES = "()[],;.:\"'"


def words_of(text: Column) -> Column:
    """Words of a text: lower case, split at white space of any kind, edge punctuation off, no empty words."""
    trimmed = F.transform(F.split(F.lower(text), WHITE_SPACE), lambda w: F.btrim(w, F.lit(EDGES)))
    return F.filter(trimmed, lambda w: w != "")


def _suffix_array(parts: list[tuple[pa.Array, ...]], longest: int | None, most: int | None) -> pa.RecordBatch | None:
    record, suffix, count = (pa.concat_arrays([p[i] for p in parts]) for i in range(3))
    record = record.dictionary_encode().indices.to_numpy().astype(np.int64)
    count = count.to_numpy()
    lists = [s.split(GLUE) for s in suffix.to_pylist()]
    flat = pa.array([w for s in lists for w in s], pa.string()).dictionary_encode()
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    longest = longest or int(sizes.max())
    ids = np.full((len(lists), longest), -1, np.int64)
    ids[np.arange(longest)[None, :] < sizes[:, None]] = flat.indices.to_numpy()
    order = np.lexsort(tuple(ids[:, k] for k in range(longest - 1, -1, -1)))  # the suffix array
    ids, record, count = ids[order], record[order], count[order]
    same = np.cumprod(ids[1:] == ids[:-1], axis=1) * (ids[1:] >= 0)
    prefix = np.concatenate([[0], same.sum(1)])  # words that a suffix shares with the one before
    words = flat.dictionary.to_pylist()
    grams, lengths, occurrences, records = [], [], [], []
    for n in range(1, min(longest, most or longest) + 1):
        long_enough = ids[:, n - 1] >= 0
        if not long_enough.any():
            break
        rows = np.flatnonzero(long_enough)
        new = prefix[rows] < n
        new[0] = True
        interval = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        by = np.lexsort((record[rows], interval))
        duplicate = np.concatenate([[False], (np.diff(interval[by]) == 0) & (np.diff(record[rows][by]) == 0)])
        occurrences.append(np.add.reduceat(count[rows], first))
        records.append(np.diff(np.append(first, len(rows))) - np.bincount(interval[by], duplicate, len(first)).astype(np.int64))
        heads = ids[rows[first], :n]
        grams += [GLUE.join(map(words.__getitem__, g)) for g in heads.tolist()]
        lengths.append(np.full(len(first), n, np.int32))
    if not grams:
        return None
    return pa.RecordBatch.from_arrays(
        [pa.array(grams, pa.string()), *(pa.array(np.concatenate(x)) for x in (lengths, occurrences, records))], names=["ngram", "n", "occurrences", "records"]
    )


def _count_parts(longest: int | None, most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (first word, record, suffix, count), sorted by the first two."""
        held: list[tuple[pa.Array, ...]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = 0
            if size + batch.num_rows > ARRAY:
                # The last border between keys in this batch. The keys before it are whole.
                a, b = batch.column(0), batch.column(1)
                n = len(a)
                differs = np.flatnonzero(
                    (a.slice(1).to_numpy(zero_copy_only=False) != a.slice(0, n - 1).to_numpy(zero_copy_only=False))
                    | (b.slice(1).to_numpy(zero_copy_only=False) != b.slice(0, n - 1).to_numpy(zero_copy_only=False))
                )
                if len(differs):
                    cut = int(differs[-1]) + 1
                    held.append(tuple(batch.column(i).slice(0, cut) for i in (1, 2, 3)))
                    if (out := _suffix_array(held, longest, most)) is not None:
                        yield out
                    held, size = [], 0
            held.append(tuple(batch.column(i).slice(cut) for i in (1, 2, 3)))
            size += batch.num_rows - cut
        if held and (out := _suffix_array(held, longest, most)) is not None:
            yield out

    return run


def ngram_counts(df: DataFrame, record: str, words: Column, longest: int | None = None, most: int | None = None) -> DataFrame:
    """``ngram, n, occurrences, records`` of all n-grams, up to ``longest`` words if given; the words of an n-gram are joined by a space.

    ``longest`` cuts the suffixes, as long texts need it; ``most`` leaves them whole and gives out the intervals of up to so many words.
    """
    kind = df.select(record).schema[0].dataType.simpleString()
    suffixes = (
        df.where(F.col(record).isNotNull())
        .select(F.col(record).alias("record"), words.alias("words"))
        .select("record", "words", F.posexplode("words").alias("at", "first"))
        .select("first", "record", F.array_join(F.slice("words", F.col("at") + 1, longest or F.size("words")), GLUE).alias("suffix"))
        .groupBy("first", "record", "suffix")
        .agg(F.count("*").alias("count"))
    )
    parts = (
        suffixes.repartition("first", "record")
        .sortWithinPartitions("first", "record")
        .mapInArrow(_count_parts(longest, most), COUNTS)
    )
    return (
        parts.groupBy("ngram", "n")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        .withColumn("ngram", F.translate("ngram", GLUE, " "))
    )


def marked(counts: DataFrame, records: Column, rare: int = 2, common_share: int = 10) -> DataFrame:
    """Adds ``mark``: ``rare`` in at most ``rare`` records, else ``common`` in more than one of ``common_share``, else null."""
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") * common_share > records, "common")
    return counts.withColumn("mark", mark)
