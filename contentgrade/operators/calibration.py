"""Component weights learned from labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentgrade.functions.scores import COMPONENTS, Weights, weighted_sum
from contentgrade.operators.labels import match_labels
from contentgrade.operators.regression import least_squares
from contentgrade.session import shared_dir


@dataclass(frozen=True)
class Calibration:
    weights: Weights
    mae: float
    mse: float
    samples: int


def learn_weights(results: DataFrame, labels: DataFrame | None = None) -> Calibration:
    """Weights whose composite comes closest to the labels, with their errors on these pages.

    Without ``labels`` the results carry their ``target_score`` already. Least squares over the five components without intercept, negative weights set to zero,
    then normalised. The pages are reduced to one triangle of six columns (see ``regression.triangle``); only that
    reaches the driver. Components that do not vary are solved with minimum norm.
    """
    matched = results if labels is None else match_labels(results, labels)
    shared_dir(results.sparkSession)
    # Six numbers per labelled page are kept, so that the pages are evaluated only once.
    samples = matched.select(
        *[F.col(f"score.components.{name}").alias(name) for name in COMPONENTS], "target_score"
    ).checkpoint()
    n = samples.count()
    if not n:
        raise ValueError("No pages matched with labels")
    solution = least_squares(samples, COMPONENTS, "target_score")
    weights = Weights(*[max(0.0, float(w)) for w in solution]).normalized()
    parts = F.struct(*COMPONENTS)
    gap = weighted_sum(parts, weights.as_column()) - F.col("target_score")
    errors = samples.agg(F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse")).first()
    return Calibration(weights, errors["mae"], errors["mse"], n)
