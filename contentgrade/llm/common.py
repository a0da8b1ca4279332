"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentgrade.operators.skew import fits_broadcast, salted_lookup
from contentgrade.session import scratch_path, shared_dir

# White space is the blank and the characters tab to carriage return, everything else is a word.
WORD = r"[^\x20\x09-\x0D]+"


# Rows hold whole documents, so a batch for a Python worker has fewer than Spark's 10,000.
BATCH_ROWS = "1000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def visible_to_workers(spark: SparkSession) -> None:
    """Settings for Python workers: small batches, unless the session asks for others.

    Workers on this machine can import the package even where it isn't installed.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    visible_to_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(table: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder; partitions and their order stay as they are."""
    shared_dir(table.sparkSession)
    return table.checkpoint()


def stored(table: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder as Parquet and read it back."""
    path = scratch_path(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def small_or_salted(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join with a stored table of one row per key: broadcast if measured small, else salted."""
    if fits_broadcast(table, 32 * 1024 * 1024):
        return rows.join(F.broadcast(table), key, "left")
    return salted_lookup(rows, table, key)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns_of(table: DataFrame) -> list[Column]:
    """All columns of a table, whatever characters are in their names."""
    return [F.col(quoted(name)) for name in table.columns]


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of equal values in the first column of a sorted stream, each as one batch."""
    carried: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if carried and values[start] != key:
                yield carried[0] if len(carried) == 1 else pa.concat_batches(carried)
                carried = []
            key = values[start]
            carried.append(batch.slice(start, end - start))
    if carried:
        yield carried[0] if len(carried) == 1 else pa.concat_batches(carried)
