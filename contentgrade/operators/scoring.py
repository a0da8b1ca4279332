"""Scores per page: heuristic, from a text model, and the mean of both."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentgrade.functions import scores as S
from contentgrade.functions.rounding import round2
from contentgrade.operators.barrier import sealed


def compute_components(
    pages: DataFrame, as_of: dt.datetime | str | Column, name: str = "components"
) -> DataFrame:
    """Add the struct of unrounded component scores to pages with metrics and metadata."""
    moment = S.relevant_date(F.col("metadata"))
    dated = pages.withColumn("_moment", moment)
    parsed = dated.withColumn("_parsed", S.iso_timestamp(F.col("_moment")))
    scored = parsed.withColumn(
        name,
        S.components(F.col("metrics"), F.col("_moment"), F.col("_parsed"), S.as_of_column(as_of)),
    )
    return sealed(scored.drop("_moment", "_parsed"))


def apply_weights(
    scored: DataFrame, weights: S.Weights | Column, components: str = "components"
) -> DataFrame:
    """Add the unrounded ``composite`` of a components struct."""
    if isinstance(weights, S.Weights):
        normalized = weights.normalized().as_column()
        return scored.withColumn("composite", S.weighted_sum(F.col(components), normalized))
    prepared = scored.withColumn("_weights", S.normalize_weights(weights))
    return prepared.withColumn(
        "composite", S.weighted_sum(F.col(components), F.col("_weights"))
    ).drop("_weights")


def apply_weight_sets(
    scored: DataFrame, weight_sets: Mapping[str, S.Weights], components: str = "components"
) -> DataFrame:
    """One row per page and weight set, with ``weight_set`` and the unrounded ``composite``.

    The sets are a literal array, so this is a narrow projection and never a join.
    """
    table = F.array(
        *[
            F.struct(F.lit(name).alias("name"), weights.normalized().as_column().alias("weights"))
            for name, weights in weight_sets.items()
        ]
    )
    spread = scored.withColumn("_set", F.explode(table))
    return spread.withColumns(
        {
            "weight_set": F.col("_set.name"),
            "composite": S.weighted_sum(F.col(components), F.col("_set.weights")),
        }
    ).drop("_set")


def _score(
    url: Column, composite: Column, parts: Sequence[Column], ml_score: Column, classified: Column
) -> Column:
    return F.struct(
        F.coalesce(url, F.lit("")).alias("url"),
        composite.alias("composite"),
        F.struct(
            *[part.alias(name) for name, part in zip(S.COMPONENTS, parts)],
            ml_score.alias("ml_score"),
        ).alias("components"),
        S.classify(classified).alias("classification"),
    )


def score_heuristic(
    pages: DataFrame, weights: S.Weights, as_of: dt.datetime | str | Column
) -> DataFrame:
    """Add ``score``; the class follows the composite before rounding."""
    weighted = apply_weights(compute_components(pages, as_of, "_components"), weights, "_components")
    values = [F.col(f"_components.{name}") for name in S.COMPONENTS]
    rounded = weighted.withColumn(
        "_rounded", F.transform(F.array(*values, "composite"), round2)
    )
    *parts, composite = [F.col("_rounded")[place] for place in range(len(values) + 1)]
    score = _score(F.col("url"), composite, parts, F.lit(None).cast("double"), F.col("composite"))
    return sealed(rounded.withColumn("score", score).drop("_components", "_rounded", "composite"))


def score_predicted(pages: DataFrame, predicted: str = "predicted_score") -> DataFrame:
    """Add ``score`` where the prediction stands in for the composite and every component."""
    rounded = pages.withColumn("_predicted", round2(F.col(predicted)))
    value = F.col("_predicted")
    score = _score(F.col("url"), value, [value] * len(S.COMPONENTS), value, value)
    return sealed(rounded.withColumn("score", score).drop("_predicted"))


def score_hybrid(
    pages: DataFrame, heuristic: str = "score", predicted: str = "predicted_score"
) -> DataFrame:
    """Replace the heuristic ``score`` by its mean with the prediction, both rounded before."""
    mixed = pages.withColumn("_predicted", round2(F.col(predicted))).withColumn(
        "_composite", (F.col(f"{heuristic}.composite") + F.col("_predicted")) / F.lit(2.0)
    )
    parts = [F.col(f"{heuristic}.components.{name}") for name in S.COMPONENTS]
    score = _score(
        F.col("url"), round2(F.col("_composite")), parts, F.col("_predicted"), F.col("_composite")
    )
    return sealed(mixed.withColumn("score", score).drop("_predicted", "_composite"))
