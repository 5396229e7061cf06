"""Tagging of a stream of document lines.

A document is a row, so the batch operators run on every micro-batch as they are. Seen keys are the stream's state:
all of them, or those inside a watermark. Pair sums are kept as one file set per batch, written under the batch's
number, so that a batch that runs again replaces its own sums; the normalised score needs all totals and is a
job over the sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termloom.operators.pairs import pair_counts, pair_scores, pair_sums, typed_pairs
from termloom.sources.files import parse_documents


def document_stream(spark: SparkSession, folder: str, files_per_batch: int = 64, watermark: str | None = None) -> DataFrame:
    """``doc_id, text`` of the files that arrive in a folder, the first line of each key.

    Without ``watermark`` keys are remembered for good; with one (as ``"1 hour"``) for that time after arrival.
    """
    lines = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_batch).text(folder)
    documents = parse_documents(lines if watermark is None else lines.withColumn("arrived", F.current_timestamp()))
    if watermark is None:
        once = documents.dropDuplicates(["doc_id"])
    else:
        once = documents.withWatermark("arrived", watermark).dropDuplicatesWithinWatermark(["doc_id"]).drop("arrived")
    return once.where("text <> ''")


def tag_stream(
    documents: DataFrame, tag: Callable[[DataFrame], DataFrame], mentions_path: str, checkpoint: str, sums_path: str | None = None, segments_of: Callable[[DataFrame], DataFrame] | None = None, segments_path: str | None = None
) -> StreamingQuery:
    """Writes the mentions (``tag`` of each micro-batch, with paragraphs and sentences), pair sums and segments of a stream.

    Each batch writes to a folder of its number: running it again overwrites, so results stay exact after a failure.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = tag(batch).persist()
        try:
            rows.write.mode("overwrite").parquet(f"{mentions_path}/batch={number}")
            if sums_path:
                pair_sums(pair_counts(rows)).write.mode("overwrite").parquet(f"{sums_path}/batch={number}")
            if segments_path and segments_of:
                segments_of(batch).write.mode("overwrite").parquet(f"{segments_path}/batch={number}")
        finally:
            rows.unpersist()

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_scores(spark: SparkSession, sums_path: str, types: DataFrame, type_pairs: DataFrame | None = None) -> DataFrame:
    """The scores of all pairs of a stream so far."""
    sums = spark.read.parquet(sums_path).groupBy("serial1", "serial2").agg(F.sum("s_ij").alias("s_ij"))
    return pair_scores(typed_pairs(sums, types, type_pairs))
