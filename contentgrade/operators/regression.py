"""Least squares over table columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentgrade.operators.aggregates import regression_metrics
from contentgrade.operators.skew import nth_smallest
from contentgrade.session import importable_by_workers, shared_dir

# Triangles that one task reduces to one in a step of the tree.
FAN_IN = 16


def prepare(
    rows: DataFrame,
    target: str,
    features: Sequence[str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Features and target as doubles, without rows in which one of them is no number.

    ``features`` defaults to all columns but the target. Columns in ``keep`` stay unchanged.
    """
    names = list(features or [c for c in rows.columns if c != target and c not in keep])
    numeric = [*names, target]
    doubles = rows.select(*keep, *[F.col(c).try_cast("double").alias(c) for c in numeric])
    valid = F.lit(True)
    for name in numeric:
        valid = valid & F.col(name).isNotNull() & ~F.isnan(name)
    return doubles.filter(valid)


def row_hash(key: Sequence[str], seed: int) -> Column:
    """Hexadecimal hash of a row key and a seed; the same in every run and partitioning."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed))))


def split(
    rows: DataFrame,
    key: Sequence[str],
    test_size: float = 0.2,
    seed: int = 0,
    exact: bool = True,
    n_test: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by the hash of a key that is unique per row.

    ``test_size`` is clamped to [0, 0.9]. An exact split has ``max(1, round(test_size * n))``
    test rows, or ``n_test`` if given, and finds the cut hash by counting; otherwise the cut
    is a fixed fraction of the hash range, which needs no pass over the data. Both sides are
    plain filters.
    """
    share = max(0.0, min(0.9, float(test_size)))
    hashed = rows.withColumn("_hash", row_hash(key, seed))
    if exact:
        wanted = n_test or (lambda n: max(1, round(share * n)))
        cut = nth_smallest(hashed.select("_hash"), "_hash", wanted)
        is_test = F.lit(True) if cut is None else F.col("_hash") <= cut
    else:
        number = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("bigint")
        is_test = number < F.lit(int(share * 2**32))
    return hashed.filter(~is_test).drop("_hash"), hashed.filter(is_test).drop("_hash")


@dataclass(frozen=True)
class LinearFit:
    """Intercept and coefficients; predicts with a plain column expression."""

    intercept: float
    coefficients: dict[str, float]

    def estimate(self) -> Column:
        total = F.lit(self.intercept)
        for name, value in self.coefficients.items():
            total = total + F.col(name) * F.lit(value)
        return total


def _reduced(block: np.ndarray) -> np.ndarray:
    """The triangle of a block's QR factors: all that least squares needs of its rows."""
    return np.linalg.qr(block, mode="r")


def triangle(rows: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """The triangular factor of the matrix of these columns, by a tree over its rows.

    Every task reduces its rows, batch by batch, to a square of the columns' number; further steps
    stack ``FAN_IN`` of these and reduce them again, until one is left for the driver. Unlike sums of
    products, that keeps the digits of nearly collinear columns.
    """
    width = len(columns)
    importable_by_workers(rows.sparkSession)

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, width))
        for batch in batches:
            block = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            held = _reduced(np.vstack([held, block])) if batch.num_rows else held
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([held.ravel().tolist()], pa.list_(pa.float64()))], names=["r"])

    def reduce_triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, width))
        for batch in batches:
            for values in batch.column(0).to_pylist():
                held = _reduced(np.vstack([held, np.array(values).reshape(-1, width)]))
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([held.ravel().tolist()], pa.list_(pa.float64()))], names=["r"])

    shared_dir(rows.sparkSession)
    level = rows.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(reduce_rows, "r array<double>").checkpoint()
    left = level.count()
    while left > FAN_IN:
        level = level.repartition(-(-left // FAN_IN)).mapInArrow(reduce_triangles, "r array<double>").checkpoint()
        left = level.count()
    found = [np.array(row["r"]).reshape(-1, width) for row in level.collect()]
    return _reduced(np.vstack(found)) if found else np.zeros((0, width))


def least_squares(rows: DataFrame, columns: Sequence[str], target: str) -> np.ndarray:
    """Weights of the columns that come closest to the target, of equally close ones the shortest.

    Rank is decided by singular values below the largest by a factor of the machine's precision times the columns.
    """
    r = triangle(rows, [*columns, target])
    if not np.isfinite(r).all():
        raise ValueError("least squares takes numbers only")
    solution, *_ = np.linalg.lstsq(r[:, :-1], r[:, -1], rcond=64 * len(columns) * np.finfo(float).eps)
    return solution


def fit_ols(rows: DataFrame, target: str, features: Sequence[str]) -> LinearFit:
    """Ordinary least squares with intercept; of equally good answers the one of the smallest norm."""
    ones = rows.select(*features, target).withColumn("_one", F.lit(1.0))
    solution = least_squares(ones, [*features, "_one"], target)
    return LinearFit(float(solution[-1]), dict(zip(features, map(float, solution[:-1]))))


def fit_evaluate(
    rows: DataFrame,
    target: str,
    features: Sequence[str] | None = None,
    key: Sequence[str] = (),
    test_size: float = 0.2,
    seed: int = 0,
) -> DataFrame:
    """Fit on the train rows and measure on the test rows: ``mae, rmse, r2, ss_res, ss_tot``.

    With fewer than three rows the mean of all of them is the prediction. Without a ``key``
    the values themselves are hashed, which sends equal rows to the same side.
    """
    names = list(features or [c for c in rows.columns if c != target and c not in key])
    keep = [c for c in key if c not in names and c != target]
    clean = prepare(rows, target, names, keep)
    if len(clean.take(3)) < 3:
        mean = clean.agg(F.avg(target)).first()[0]
        return regression_metrics(
            clean.select(F.col(target).alias("actual"), F.lit(mean).cast("double").alias("estimate"))
        )
    train, test = split(clean, key or [*names, target], test_size, seed)
    # A share that leaves nothing to learn from leaves coefficients of zero.
    fit = LinearFit(0.0, dict.fromkeys(names, 0.0)) if train.isEmpty() else fit_ols(train, target, names)
    return regression_metrics(
        test.select(F.col(target).alias("actual"), fit.estimate().alias("estimate"))
    )
