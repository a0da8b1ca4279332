"""Summaries, rankings and error measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentgrade.functions.rounding import round2


def summary(results: DataFrame, composite: Column | None = None) -> DataFrame:
    """Count, average, minimum and maximum of the rounded composites; zeros without rows.

    The composites have two decimals, so the average is taken over whole hundredths: the
    sum is then exact and does not depend on the order of the partitions.
    """
    value = F.col("score.composite") if composite is None else composite
    hundredths = F.round(value * 100).cast("bigint")
    totals = results.agg(
        F.count(value).alias("count"),
        F.sum(hundredths).alias("total"),
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
    )
    average = F.col("total") / (F.nullif("count", F.lit(0)) * F.lit(100.0))
    return totals.select(
        "count",
        F.coalesce(round2(average), F.lit(0.0)).alias("average"),
        F.coalesce(round2(F.col("minimum")), F.lit(0.0)).alias("minimum"),
        F.coalesce(round2(F.col("maximum")), F.lit(0.0)).alias("maximum"),
    )


def top_pages(results: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best pages, ties by url."""
    return results.orderBy(F.col("score.composite").desc(), F.col("url")).limit(k)


def regression_metrics(
    predicted: DataFrame, actual: str = "actual", estimate: str = "estimate"
) -> DataFrame:
    """``mae, rmse, r2, ss_res, ss_tot`` in one pass.

    The total sum of squares comes from the population variance, which Spark merges from
    partial central moments; no second pass around the mean is needed.
    """
    residual = F.col(actual) - F.col(estimate)
    sums = predicted.agg(
        F.avg(F.abs(residual)).alias("mae"),
        F.avg(residual * residual).alias("mse"),
        F.sum(residual * residual).alias("ss_res"),
        (F.var_pop(actual) * F.count(actual)).alias("ss_tot"),
    )
    r2 = F.when(F.col("ss_tot") > 0, 1.0 - F.col("ss_res") / F.col("ss_tot")).otherwise(F.lit(0.0))
    return sums.select(
        "mae", F.sqrt("mse").alias("rmse"), r2.alias("r2"), "ss_res", "ss_tot"
    )


def classifier_metrics(
    predicted: DataFrame, actual: str = "target_score", estimate: str = "predicted_score"
) -> DataFrame:
    """Mean absolute and squared error between class midpoints, to two decimals, and the count."""
    gap = F.col(actual) - F.col(estimate)
    return predicted.agg(
        F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse"), F.count(gap).alias("samples")
    ).select(round2(F.col("mae")).alias("mae"), round2(F.col("mse")).alias("mse"), "samples")
