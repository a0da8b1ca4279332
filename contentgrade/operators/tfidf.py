"""TF-IDF features of unigrams and bigrams."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, StopWordsRemover
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentgrade.functions.text import WORD
from contentgrade.session import shared_dir

MAX_FEATURES = 500


@cache
def english_stop_words() -> tuple[str, ...]:
    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


def tokens(text: Column, stop_words: Sequence[str]) -> Column:
    """Lower-case words of two or more characters, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD + "{2,}+"), F.lit(0))
    return F.filter(words, lambda word: ~word.isin(*stop_words)) if stop_words else words


def bigrams(words: Column) -> Column:
    """All pairs of neighbours. Reads its input several times."""
    n_pairs = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(
        F.slice(words, F.lit(1), n_pairs),
        F.slice(words, F.lit(2), n_pairs),
        lambda left, right: F.concat(left, F.lit(" "), right),
    )


def with_terms(rows: DataFrame, text: str, stop_words: Sequence[str]) -> DataFrame:
    """Add ``_terms``, the words and bigrams of a text, which is taken apart once."""
    worded = rows.withColumn("_words", tokens(F.coalesce(text, F.lit("")), stop_words))
    return worded.withColumn("_terms", F.concat("_words", bigrams(F.col("_words")))).drop("_words")


@dataclass(frozen=True)
class Vocabulary:
    """Terms with corpus count, document count and weight. At most ``max_features`` of them."""

    terms: tuple[str, ...]
    counts: tuple[int, ...]
    document_counts: tuple[int, ...]
    idf: tuple[float, ...]
    documents: int
    stop_words: tuple[str, ...]

    def rows(self) -> list[tuple[str, int, int, float]]:
        return list(zip(self.terms, self.counts, self.document_counts, self.idf))


ROW_SCHEMA = "term string, corpus_count bigint, document_count bigint, idf double"


# Terms that a task's summary of the frequent ones holds, and the buckets, for each term asked
# for, that all others are counted in. Both set the cost only, never the result.
TRACKED = 1 << 14
BUCKETS = 512


def _likely(terms: DataFrame, max_features: int) -> DataFrame:
    """Up to ``max_features`` terms that are probably the most frequent ones.

    Every task keeps a summary of frequent items of bounded size, and summaries are merged.
    """
    tracked = min(max(TRACKED, 4 * max_features), 1_000_000)
    found = F.expr(f"approx_top_k(term, {min(max_features, tracked)}, {tracked})")
    return terms.agg(found.alias("_top")).select(F.inline("_top")).select(F.col("item").alias("term"))


def top_terms(terms: DataFrame, max_features: int) -> list[tuple[str, int]]:
    """The most frequent values of ``term`` with their counts, ties by term. Exact.

    A summary names twice as many likely ones. One pass counts these exactly and all other terms by
    the bucket of their hash, so what moves is at most a number per bucket and task. A
    term that the summary missed can belong to the result only if its whole bucket has as
    many rows as the last that the likely ones give. Terms beyond the likely ones have far fewer, so
    there are mostly no such buckets; otherwise their terms are counted by themselves.
    """
    spark = terms.sparkSession
    likely = [row["term"] for row in _likely(terms, 2 * max_features).collect()]
    if not likely:
        return []
    # At most twice the rows that the result has.
    marked = F.broadcast(spark.createDataFrame([(term, term) for term in likely], "term string, _likely string"))
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS * max_features)).alias("_bucket")
    others = F.when(F.col("_likely").isNull(), bucket).alias("_bucket")
    counts = terms.join(marked, "term", "left").groupBy("_likely", others).agg(F.count("*").alias("n")).checkpoint()
    best = [(row["_likely"], row["n"]) for row in counts.filter("_likely IS NOT NULL").collect()]
    least = sorted((n for _, n in best), reverse=True)[max_features - 1] if len(best) >= max_features else 1
    full = counts.filter(F.col("_likely").isNull() & (F.col("n") >= least)).select("_bucket")
    if not full.isEmpty():
        missed = (
            terms.select("term", bucket)
            .join(F.broadcast(full), "_bucket")
            .join(marked, "term", "left_anti")
            .groupBy("term")
            .agg(F.count("*").alias("n"))
            .filter(F.col("n") >= least)
            .orderBy(F.col("n").desc(), "term")
            .limit(max_features)
        )
        best += [(row["term"], row["n"]) for row in missed.collect()]
    return sorted(best, key=lambda t: (-t[1], t[0]))[:max_features]


def _counted(termed: DataFrame, terms: Sequence[str], out: str) -> DataFrame:
    """Turn ``_terms`` into the sparse vector of counts."""
    counter = CountVectorizerModel.from_vocabulary(list(terms), inputCol="_terms", outputCol=out)
    return counter.transform(termed).drop("_terms")


def fit_tfidf(
    rows: DataFrame,
    text: str = "text",
    max_features: int = MAX_FEATURES,
    stop_words: Sequence[str] | None = None,
) -> Vocabulary:
    """The most frequent terms of the corpus and their weights ``ln((1 + n) / (1 + df)) + 1``.

    Texts are taken apart in one pass, which stores their terms in the shared folder; all
    counts read those. Document counts come last and need the chosen terms only: each
    document becomes a sparse vector and the non-zero entries are added up per position.
    """
    kept = english_stop_words() if stop_words is None else tuple(stop_words)
    shared_dir(rows.sparkSession)
    termed = with_terms(rows.select(text), text, kept).select("_terms").checkpoint()
    ranked = top_terms(termed.select(F.explode("_terms").alias("term")), max_features)
    if not ranked:
        raise ValueError("No terms in the corpus")
    terms, counts = zip(*ranked)
    vectors = _counted(termed, terms, "_counts")
    totals = vectors.select(
        Summarizer.metrics("count", "numNonZeros").summary(F.col("_counts")).alias("s")
    ).select(
        F.col("s.count").alias("n"),
        F.col("s.numNonZeros").alias("df"),
    ).first()
    n = int(totals["n"])
    df = tuple(int(value) for value in totals["df"])
    idf = tuple(math.log((1 + n) / (1 + d)) + 1 for d in df)
    return Vocabulary(terms, counts, df, idf, n, kept)


def tfidf_transform(
    rows: DataFrame, vocabulary: Vocabulary, text: str = "text", features: str = "features"
) -> DataFrame:
    """Add the sparse vector of term weights with length one. Narrow: no shuffle, no explode."""
    counted = _counted(with_terms(rows, text, vocabulary.stop_words), vocabulary.terms, "_counts")
    scale = ElementwiseProduct(
        scalingVec=Vectors.dense(vocabulary.idf), inputCol="_counts", outputCol="_scaled"
    )
    unit = Normalizer(p=2.0, inputCol="_scaled", outputCol=features)
    return unit.transform(scale.transform(counted)).drop("_counts", "_scaled")
