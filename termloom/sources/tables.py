"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Read ``<folder>/<name>.parquet`` (a file or a folder of part files); with ``columns`` only these."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Up to so many bytes for each core, dealing out the rows of a scan costs less than cores without work.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A scan for a costly pass: the rows of small files, which may be a single row group and so a single task, are dealt out to all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df
