"""Fetch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contentgrade.schemas import FETCHES


def read_fetches(spark: SparkSession, path: str) -> DataFrame:
    """Stored fetch outcomes, failures included, with the fixed schema."""
    return spark.read.schema(FETCHES).parquet(path)


def stream_fetches(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """The same table read as its files arrive."""
    reader = spark.readStream.schema(FETCHES)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """Repartition a table that has fewer splits than the cluster has cores.

    Parsing costs far more than moving the rows, and one small file with one row group would
    otherwise keep one core busy. Tables with enough splits, as all large ones have, are
    returned unchanged.
    """
    wanted = rows.sparkSession.sparkContext.defaultParallelism
    if rows.isStreaming or rows.rdd.getNumPartitions() >= wanted:
        return rows
    return rows.repartition(wanted)
