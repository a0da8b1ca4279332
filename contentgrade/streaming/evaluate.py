"""The batch computations over a stream of fetches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contentgrade.operators.aggregates import summary
from contentgrade.plans.evaluate import evaluate_pages


def evaluate_stream(fetches: DataFrame, as_of, **options) -> DataFrame:
    """Scored pages of a streaming fetch table; stateless, so append mode suffices."""
    if not fetches.isStreaming:
        raise ValueError("evaluate_stream needs a streaming table")
    return evaluate_pages(fetches, as_of, **options)


def summary_stream(results: DataFrame) -> DataFrame:
    """The summary as a running aggregate, for complete mode. The state is one row."""
    return summary(results)


def write_results(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append scored pages to a parquet folder until the input at hand is used up."""
    return (
        results.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def write_summary(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store the summary after each batch, below its number, until the input at hand is used up.

    A batch that is run again replaces its own summary only, so readers of
    :func:`read_summary` find the last complete one at any time.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        totals.writeStream.outputMode("complete")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The summary of the last batch."""
    batches = spark.read.parquet(path)
    last = batches.agg(F.max("batch")).first()[0]
    return batches.filter(F.col("batch") == last).drop("batch")
