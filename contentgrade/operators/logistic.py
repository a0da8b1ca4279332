"""Regularised logistic regression over sparse features, with the same result for any partitioning.

The loss is a sum over rows, and so is its gradient. Floating-point sums depend on their
order, which follows from partitions and task timing. Here every row's share is rounded to a
multiple of a small power of two first; whole numbers add up to the same total in any order,
so the same rows give the same coefficients to the last bit on one task or on thousands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentgrade.session import importable_by_workers

# Shares of the loss and of the gradient are multiples of 2**-BITS.
BITS = 36
MAX_ITERATIONS = 1000
# The fit ends when no entry of the gradient of the summed loss is larger.
TOLERANCE = 1e-5
HISTORY = 20
# Rows added up in floating point; their whole numbers stay below 2**53, so these sums are exact.
_EXACT_ROWS = 1 << 13
# The products of the first features with each other make the curvature that steps are scaled by; of
# others only the squares count. Values are multiples of 2**-_FINE there, up to 2**_MOST of them.
CURVED = 1000
_FINE, _MOST, _CURVED_ROWS = 16, 18, 1 << 11


@dataclass(frozen=True)
class LogisticFit:
    """One row of weights and one intercept per class; with two classes those of the first are zero."""

    classes: tuple[int, ...]
    weights: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]

    def predicted(self, features: Column) -> Column:
        """The class of the largest margin for an array of features, of equal ones the smallest."""
        margins = [
            F.struct(
                F.aggregate(
                    F.zip_with(features, F.array(*[F.lit(w) for w in weights]), lambda x, w: x * w),
                    F.lit(intercept),
                    lambda total, x: total + x,
                ).alias("margin"),
                F.lit(-label).alias("negative"),
            )
            for label, weights, intercept in zip(self.classes, self.weights, self.intercepts)
        ]
        return -F.array_max(F.array(*margins))["negative"]


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(np.ldexp(x, BITS))


def _shares(weights: np.ndarray, label: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray) -> tuple[int, np.ndarray]:
    """Loss and gradient of some rows as whole numbers; the last column of weights is the intercept.

    Margins are added up entry by entry in the order of a row, so a row's share does not
    depend on the rows beside it.
    """
    n = len(label)
    margins = np.stack([np.bincount(row, value * w[column], n) + w[-1] for w in weights], axis=1)
    if len(weights) == 1:
        z = margins[:, 0]
        loss = np.logaddexp(0, z) - label * z
        rest = (1 / (1 + np.exp(-z)) - label)[:, None]
    else:
        top = margins.max(axis=1)
        powers = np.exp(margins - top[:, None])
        total = np.zeros(n)
        for k in range(len(weights)):
            total += powers[:, k]
        loss = np.log(total) + top - margins[np.arange(n), label]
        rest = powers / total[:, None]
        rest[np.arange(n), label] -= 1
    gradient = np.empty(weights.shape, dtype=np.int64)
    for k in range(len(weights)):
        gradient[k, :-1] = np.bincount(column, _whole(rest[row, k] * value), weights.shape[1] - 1)
        gradient[k, -1] = _whole(rest[:, k]).sum()
    return int(_whole(loss).astype(np.int64).sum()), gradient


def _totals(rows: DataFrame, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss and gradient over all rows: one job, of which the driver sees one number per coefficient."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, gradient = 0, np.zeros(weights.shape, dtype=np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, _EXACT_ROWS):
                batch = whole.slice(start, _EXACT_ROWS)
                indices, values = batch.column(1), batch.column(2)
                row = np.repeat(np.arange(batch.num_rows), np.diff(indices.offsets.to_numpy()))
                column, value = indices.flatten().to_numpy(), values.flatten().to_numpy()
                some, more = _shares(weights, batch.column(0).to_numpy(), row, column, value)
                loss, gradient = loss + some, gradient + more
        if loss:
            shares = np.append(gradient.ravel(), loss)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(shares))), pa.array(shares)], names=["at", "share"])

    shares = rows.select("label", "indices", "values").mapInArrow(add, "at long, share long")
    sums = shares.groupBy("at").agg(F.sum(F.col("share").cast("decimal(38,0)")).alias("sum")).collect()
    found = np.zeros(weights.size + 1)
    for row in sums:
        found[row["at"]] = int(row["sum"]) / (1 << BITS)
    return float(found[-1]), found[:-1].reshape(weights.shape)


def _products(rows: DataFrame, classes: int, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows per class, sums of products of the leading features and the intercept, and of squares of the others.

    Added up as whole numbers in one job, of which the driver sees the sums.
    """
    lead = min(features, CURVED)
    above = np.triu_indices(lead + 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, squares = np.zeros(classes, dtype=np.int64), np.zeros(features - lead, dtype=np.int64)
        products = np.zeros((lead + 1, lead + 1), dtype=np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, _CURVED_ROWS):
                batch = whole.slice(start, _CURVED_ROWS)
                indices = batch.column(1)
                row = np.repeat(np.arange(batch.num_rows), np.diff(indices.offsets.to_numpy()))
                column, value = indices.flatten().to_numpy(), batch.column(2).flatten().to_numpy()
                value = np.clip(np.rint(np.ldexp(value, _FINE)), -(1 << _MOST), 1 << _MOST)
                leads = column < lead
                dense = np.zeros((batch.num_rows, lead + 1))
                dense[row[leads], column[leads]] = value[leads]
                dense[:, -1] = 1 << _FINE
                products += (dense.T @ dense).astype(np.int64)
                squares += np.bincount(column[~leads] - lead, value[~leads] ** 2, features - lead).astype(np.int64)
                sizes += np.bincount(batch.column(0).to_numpy(), minlength=classes)
        if sizes.any():
            shares = np.concatenate([sizes, products[above], squares])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(shares))), pa.array(shares)], names=["at", "share"])

    shares = rows.select("label", "indices", "values").mapInArrow(add, "at long, share long")
    sums = shares.groupBy("at").agg(F.sum(F.col("share").cast("decimal(38,0)")).cast("double").alias("sum")).toArrow()
    found = np.zeros(classes + len(above[0]) + features - lead)
    found[sums.column("at").to_numpy()] = sums.column("sum").to_numpy()
    sizes, upper, squares = np.split(found, [classes, classes + len(above[0])])
    products = np.zeros((lead + 1, lead + 1))
    products[above] = np.ldexp(upper, -2 * _FINE)
    products += np.triu(products, 1).T
    return sizes, products, np.ldexp(squares, -2 * _FINE)


def _inverse(positive: np.ndarray) -> np.ndarray:
    """The inverse of a symmetric positive matrix, a row at a time.

    It leaves out BLAS: its threads can hang in a driver that has forked its JVM.
    """
    found = positive.copy()
    for i in range(len(found)):
        pivot, row, column = found[i, i], found[i] / found[i, i], found[:, i].copy()
        found -= np.multiply.outer(column, row)
        found[i], found[:, i] = row, -column / pivot
        found[i, i] = 1 / pivot
    return found


def _scaled_by_curvature(
    shares: np.ndarray, products: np.ndarray, squares: np.ndarray, free: np.ndarray
) -> Callable[[np.ndarray], np.ndarray]:
    """Slopes times the inverse of the second derivatives, as they are where every row has its class by ``shares`` alone.

    These are a product of a matrix over classes and one over features; the axes of the former
    part them into one matrix per axis.
    """
    of_classes = np.diag(shares) - np.outer(shares, shares)
    if len(free) == 1:
        of_classes = of_classes[1:, 1:]
    sizes, axes = np.linalg.eigh(of_classes)
    sizes = np.maximum(sizes, 0)
    least = np.where(free[0] > 0, free[0], 1.0)
    lead = np.append(np.arange(len(products) - 1), free.shape[1] - 1)
    others = np.arange(len(products) - 1, free.shape[1] - 1)
    inverses = [_inverse(size * products + np.diag(least[lead])) for size in sizes]

    def scaled(slope: np.ndarray) -> np.ndarray:
        turned = np.einsum("jk,jf->kf", axes, slope)
        out = np.empty_like(turned)
        for k, (size, inverse) in enumerate(zip(sizes, inverses, strict=True)):
            out[k, lead] = np.einsum("ij,j->i", inverse, turned[k, lead])
            out[k, others] = turned[k, others] / (size * squares + least[others])
        return np.einsum("jk,kf->jf", axes, out)

    return scaled


def minimise(
    evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]],
    start: np.ndarray,
    tolerance: float,
    max_iterations: int,
    slack: float,
    scaled: Callable[[np.ndarray], np.ndarray],
) -> np.ndarray:
    """The minimum of a smooth convex function by limited-memory quasi-Newton steps.

    ``scaled`` multiplies a slope by a positive matrix close to the inverse of the second derivatives: the
    closer, the fewer steps. ``slack`` is how far the function's values may be off. A step that halving doesn't
    mend ends the search.
    """
    at = start
    value, slope = evaluate(at)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(max_iterations):
        if np.abs(slope).max() <= tolerance:
            break
        direction = slope.copy()
        seen = []
        for s, y, rho in reversed(steps):
            a = rho * float(np.vdot(s, direction))
            direction -= a * y
            seen.append(a)
        direction = scaled(direction)
        if steps:
            s, y, _ = steps[-1]
            direction *= float(np.vdot(s, y)) / float(np.vdot(y, scaled(y)))
        for (s, y, rho), a in zip(steps, reversed(seen), strict=True):
            direction += (a - rho * float(np.vdot(y, direction))) * s
        descent = float(np.vdot(slope, direction))
        if descent <= 0:
            steps.clear()
            direction, descent = slope / max(1.0, float(np.abs(slope).sum())), float(np.vdot(slope, slope))
        length = 1.0
        while True:
            there = at - length * direction
            value_there, slope_there = evaluate(there)
            if value_there <= value - 1e-4 * length * descent + slack:
                break
            length /= 2
            if length < 1e-10:
                return at
        s, y = there - at, slope_there - slope
        curvature = float(np.vdot(s, y))
        if curvature > 0:
            steps = [*steps, (s, y, 1 / curvature)][-HISTORY:]
        at, value, slope = there, value_there, slope_there
    return at


def fit_logistic(rows: DataFrame, classes: tuple[int, ...], features: int, samples: int, penalty: float = 1.0) -> LogisticFit:
    """Weights that minimise the summed log loss plus half the ``penalty`` times their squares.

    ``rows`` has ``label`` (the place in ``classes``), ``indices`` and ``values`` (the non-zero
    features), and is read once per step, so it is best a stored table. Two classes have one weight per
    feature, more have one per feature and class. Intercepts are free. Steps are scaled by the products of
    features, which one job adds up first, so their number hardly grows with that of the rows.
    """
    if len(classes) < 2:
        raise ValueError("training needs rows of at least two classes")
    importable_by_workers(rows.sparkSession)
    shape = (1 if len(classes) == 2 else len(classes), features + 1)
    free = np.full(shape, penalty)
    free[:, -1] = 0

    def evaluate(weights: np.ndarray) -> tuple[float, np.ndarray]:
        loss, gradient = _totals(rows, weights)
        return loss + 0.5 * float((free * weights * weights).sum()), gradient + free * weights

    sizes, products, squares = _products(rows, len(classes), features)
    shares = (sizes + 1) / (sizes + 1).sum()
    start = np.zeros(shape)
    start[:, -1] = np.log(shares[1:] / shares[0]) if len(classes) == 2 else np.log(shares) - np.log(shares).mean()
    slack = (samples + 1) * 2.0 ** (1 - BITS)
    tolerance = TOLERANCE * max(1.0, samples / 1000)
    weights = minimise(evaluate, start, tolerance, MAX_ITERATIONS, slack, _scaled_by_curvature(shares, products, squares, free))
    if len(classes) == 2:
        weights = np.vstack([np.zeros_like(weights), weights])
    return LogisticFit(tuple(classes), tuple(map(tuple, weights[:, :-1].tolist())), tuple(weights[:, -1].tolist()))
