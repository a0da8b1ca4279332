"""A training corpus from documents: quality, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentgrade.llm import linededup, mixing, neardup, packing, quality
from contentgrade.llm.common import columns_of, read, small_or_salted, stored, visible_to_workers, word_count
from contentgrade.session import scratch_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a quality score of at least one half, learned from the labels.

    A null text counts as an empty one; repeated rows are scored alike, so they stay or go
    together. An empty table stays empty. Columns of any name are kept.
    """
    visible_to_workers(spark)
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one but for two edits; n_chars follows.

    A null or an empty text has no lines and stays as it is. Of repeated rows the lines of one
    stay. A document goes if nothing of its text is left.
    """
    visible_to_workers(spark)
    left = linededup.dedup_lines(docs)
    return left.withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), F.col("n_chars")))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles.

    A document without words or without an id belongs to no group. Rows that repeat a kept
    document's id and text stay with it.
    """
    visible_to_workers(spark)
    classes = neardup.near_duplicates(docs, words=5, similarity_percent=80)
    gone = classes.filter("doc_id is not null and not kept").select("doc_id").distinct()
    gone = stored(gone.withColumn("_gone", F.lit(True)), "near-gone")
    return small_or_salted(docs, gone, "doc_id").filter("_gone is null").select(*columns_of(docs))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document; what it doesn't take goes.

    A null source is a source of its own, a text without words has size 0, and rows of one
    doc_id are taken alike.
    """
    return mixing.mixed(docs, size=word_count(F.col("text")), key=F.col("doc_id"))


def pack_into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens.

    A null text is packed as an empty one; each of several equal rows has its own place.
    """
    visible_to_workers(spark)
    return packing.pack_documents(docs, capacity=1024)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near),
    ("mixing", mix_to_targets),
    ("packing", pack_into_sequences),
]

# The quality stage has a model and the near-dedup stage confirms candidates of random trees;
# SQL expresses neither, so tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
