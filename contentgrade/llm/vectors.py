"""What the two vector searches share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(rows: DataFrame, key: str, vector: str, zeros: bool) -> DataFrame:
    """Columns ``vec_id`` and ``vec`` (doubles) of the rows that take part, equal rows once.

    Left out are null ids and null or empty vectors, vectors with a null or a non-finite
    component and, unless ``zeros``, those of nothing but zeros. Vectors of all lengths stay;
    an inner product is defined between vectors of one length only.
    """
    found = rows.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = found.filter(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & finite)
    if not zeros:
        found = found.filter(F.exists("vec", lambda x: x != 0))
    return found.withColumn("version", F.xxhash64("vec")).dropDuplicates(["vec_id", "version"])


def rows_of(column: pa.Array, kind: str = "float64") -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if not len(column):
        return np.empty((0, 0), dtype=kind)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, dtype=kind).reshape(len(column), -1)


def by_length(batch: pa.RecordBatch, column: int) -> dict[int, pa.RecordBatch]:
    """The rows of a batch by the length of a list column."""
    lengths = batch.column(column).value_lengths().to_numpy()
    found = np.unique(lengths)
    if len(found) == 1:
        return {int(found[0]): batch}
    return {int(n): batch.take(pa.array(np.flatnonzero(lengths == n))) for n in found}


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query from the best of its parts, ties to the smaller vec_id."""
    best = found.groupBy("query_id", "query_version", "vec_id", "version").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id", "query_version").orderBy(F.desc("score"), "vec_id", "version")
    return (
        best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
