"""Byte-wise views of text.

All positions of the engine are byte positions in UTF-8, the end of a match inclusive. ``latin`` maps a string to one
whose characters are its bytes, so that Spark's string functions count bytes; ``from_latin`` maps back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latin(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def from_latin(text: Column) -> Column:
    return F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")


def byte_slice(text: Column, start: Column, stop: Column) -> Column:
    """The bytes ``start`` to ``stop`` (from 0, inclusive) of a string."""
    return from_latin(F.substring(latin(text), start + 1, stop - start + 1))


def to_character(text: Column, byte: Column) -> Column:
    """The number of code points before a byte position."""
    return F.length(from_latin(F.substring(latin(text), F.lit(1), byte)))


def character_spans(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` (``doc_id, start, stop`` in bytes, the last inclusive) with ``begin, end`` in code points, the end exclusive, and
    ``aligned``: whether the first and the last byte both begin a character.

    The spans of a document meet its text once, and a running count of its characters answers them all. Each span comes
    out once; spans of documents that aren't there, or beyond the end, don't.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    lists = spans.groupBy("doc_id").agg(F.collect_set(F.struct(F.col("start").cast("int"), F.col("stop").cast("int"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, own in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
                first = (b & 0xC0) != 0x80
                count = np.concatenate([[0], np.cumsum(first)])
                start, stop = (own.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                known = (start >= 0) & (start <= stop) & (stop < len(b))
                start, stop = start[known], stop[known]
                if len(start):
                    columns = (start, stop, count[start + 1] - 1, count[stop + 1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc.as_py()] * len(start), doc.type), *(pa.array(c, pa.int32()) for c in columns), pa.array(first[start] & first[stop])],
                        names=["doc_id", "start", "stop", "begin", "end", "aligned"],
                    )

    found = documents.select("doc_id", "text").join(lists, "doc_id")
    return found.mapInArrow(run, f"doc_id {kind}, start int, stop int, begin int, end int, aligned boolean")


def leading_integer(text: Column, kind: str = "bigint") -> Column:
    """The whole number at the start of a string, 0 where there is none: as C's atoi."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast(kind), F.lit(0).cast(kind))
