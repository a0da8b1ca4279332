"""Pages meet their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentgrade.functions.urls import label_url_key
from contentgrade.operators.skew import lookup


def match_labels(results: DataFrame, labels: DataFrame, salts: int = 16) -> DataFrame:
    """Pages with the ``target_score`` of their label; pages without a label are dropped.

    Works on fetches as well, which spares parsing the pages that have no label. Labels are
    unique per key. A table of labels that is small, as human labels are, is broadcast;
    beyond that, a url that was stored many times is spread over ``salts`` partitions.
    """
    targets = labels.select(F.col("url_key").alias("_key"), "target_score")
    keyed = results.withColumn("_key", label_url_key(F.col("url")))
    matched = lookup(keyed, targets, "_key", salts, F.col(_spread_column(results)))
    return matched.filter(F.col("target_score").isNotNull()).drop("_key")


def _spread_column(results: DataFrame) -> str:
    """A column that differs between stored copies of one page."""
    return "fetched_at" if "fetched_at" in results.columns else results.columns[0]
