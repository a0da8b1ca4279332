"""Component weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contentgrade.functions.scores import COMPONENTS, Weights

_TEXT = T.StructType([T.StructField(name, T.StringType()) for name in COMPONENTS])


def read_weights(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Weights from JSON objects, one per file or, with ``lines``, one per line.

    Missing keys take the defaults and unknown keys are ignored.
    """
    stored = spark.read.schema(_TEXT).json(path, multiLine=not lines)
    defaults = Weights().as_dict()
    return stored.select(
        *[
            F.coalesce(F.col(name).cast("double"), F.lit(defaults[name])).alias(name)
            for name in COMPONENTS
        ]
    )


def load_weights(spark: SparkSession, path: str) -> Weights:
    """The weights of one JSON file, for use as literals in a plan."""
    row = read_weights(spark, path).first()
    if row is None:
        raise ValueError("weights must be a JSON object")
    return Weights(**row.asDict())
