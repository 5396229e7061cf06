"""User code that sees documents one after the other, mention by mention.

A handler is made anew in each partition. Documents, segments and mentions come in one stream sorted by document and
place, so that no document's mentions are held; what a handler gives out are rows of a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BEGIN, _SEGMENT, _MATCH, _END = range(4)


class DocumentHandler:
    """Methods that a handler may have. Each gives rows, as tuples of the result's columns, or nothing."""

    def on_batch_begin(self) -> Iterable[tuple] | None: ...

    def on_batch_end(self) -> Iterable[tuple] | None: ...

    def on_document_begin(self, doc_id: object, text: str | None) -> Iterable[tuple] | None: ...

    def on_document_end(self, doc_id: object) -> Iterable[tuple] | None: ...

    def on_paragraph_begin(self) -> Iterable[tuple] | None: ...

    def on_paragraph_end(self) -> Iterable[tuple] | None: ...

    def on_sentence_begin(self) -> Iterable[tuple] | None: ...

    def on_sentence_end(self) -> Iterable[tuple] | None: ...

    def on_match(self, doc_id: object, start: int, stop: int, text: str, entities: tuple[tuple[int, int | None, str | None], ...]) -> Iterable[tuple] | None: ...


def handled(documents: DataFrame, matches: DataFrame, make: Callable[[], DocumentHandler], schema: str, segments: DataFrame | None = None, rows_at_once: int = 10_000) -> DataFrame:
    """The rows that handlers give out, as a table of ``schema``.

    ``documents`` has ``doc_id, text``, ``matches`` is as ``find_mentions`` gives it. With ``segments`` (``doc_id, paragraph,
    sentence, begin, end``) the begins and ends of paragraphs and sentences are told too, and a mention in none of them isn't.
    A batch is a partition; a document of no mentions is told all the same, mentions of no document aren't.
    """
    rows = documents.select("doc_id", F.lit(_BEGIN).alias("kind"), F.lit(-1).alias("start"), F.lit(0).alias("stop"), "text", F.lit(None).cast(matches.schema["entities"].dataType).alias("entities"), F.lit(0).alias("paragraph"))
    rows = rows.unionByName(matches.select("doc_id", F.lit(_MATCH).alias("kind"), "start", "stop", "text", "entities"), allowMissingColumns=True)
    if segments is not None:
        rows = rows.unionByName(segments.select("doc_id", F.lit(_SEGMENT).alias("kind"), F.col("begin").alias("start"), F.col("end").alias("stop"), "paragraph"), allowMissingColumns=True)
    structured = segments is not None
    ordered = rows.repartition("doc_id").sortWithinPartitions("doc_id", "start", "kind")
    kinds = documents.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        events = _events(make(), batches, structured)
        held: list[tuple] = []
        for row in events:
            held.append(row)
            if len(held) >= rows_at_once:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    return ordered.mapInArrow(run, schema)


def _events(handler: DocumentHandler, batches: Iterator[pa.RecordBatch], structured: bool) -> Iterator[tuple]:
    yield from handler.on_batch_begin() or ()
    doc, known, inside, paragraph = None, False, -1, None

    def close(to: int | None) -> Iterator[tuple]:
        """Ends the open sentence, and the paragraph unless it is number ``to``."""
        nonlocal inside, paragraph
        if inside >= 0:
            yield from handler.on_sentence_end() or ()
        if paragraph is not None and paragraph != to:
            yield from handler.on_paragraph_end() or ()
            paragraph = None
        inside = -1

    def finish() -> Iterator[tuple]:
        if known:
            yield from close(None)
            yield from handler.on_document_end(doc) or ()

    for batch in batches:
        for d, kind, start, stop, text, entities, number in zip(*(batch.column(c).to_pylist() for c in range(7))):
            if kind == _BEGIN:
                yield from finish()
                doc, known = d, True
                yield from handler.on_document_begin(d, text) or ()
            elif not known or d != doc:
                yield from finish()
                doc, known = d, False
            elif kind == _SEGMENT:
                yield from close(number)
                if paragraph is None:
                    paragraph = number
                    yield from handler.on_paragraph_begin() or ()
                inside = stop
                yield from handler.on_sentence_begin() or ()
            elif not structured or stop < inside:
                yield from handler.on_match(d, start, stop, text, tuple((e["type"], e["serial"], e["identifier"]) for e in entities)) or ()
    yield from finish()
    yield from handler.on_batch_end() or ()
