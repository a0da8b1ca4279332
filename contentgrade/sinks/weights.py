"""Weights as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentgrade.functions.scores import COMPONENTS, Weights, normalize_weights


def write_weights(
    weights: Weights | DataFrame,
    path: str,
    spark: SparkSession | None = None,
    normalize: bool = False,
    mode: str = "overwrite",
) -> None:
    """Write weights, raw or normalised, as JSON objects that ``read_weights`` reads back."""
    if isinstance(weights, Weights):
        session = spark or SparkSession.active()
        weights = session.range(1).select(weights.as_column().alias("w")).select("w.*")
    columns = F.struct(*COMPONENTS)
    chosen = normalize_weights(columns) if normalize else columns
    weights.select(chosen.alias("w")).select("w.*").write.mode(mode).json(path)
