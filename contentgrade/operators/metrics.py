"""Text metrics per page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentgrade.functions import text as X
from contentgrade.operators.barrier import sealed


def extract_metrics(
    pages: DataFrame,
    lexicon: Sequence[str] = X.DOMAIN_TERMS,
    formula_signs: Sequence[str] = X.FORMULA_SIGNS,
    formula_patterns: Sequence[str] = X.FORMULA_PATTERNS,
    citation_patterns: Sequence[str] = X.CITATION_PATTERNS,
) -> DataFrame:
    """Add the ``metrics`` struct to pages with ``text`` and ``html``.

    The lower-cased text and the number tokens are columns of their own projection because
    several metrics read them.
    """
    text = F.col("text")
    prepared = pages.withColumns(
        {"_lowered": F.lower(text), "_numbers": X.numeric_token_list(text)}
    )
    metrics = F.struct(
        X.word_count(F.col("_lowered")).alias("word_count"),
        X.term_counts(F.col("_lowered"), lexicon).alias("actuarial_terms"),
        F.size("_numbers").cast("bigint").alias("numeric_tokens"),
        X.has_formula(text, formula_signs, formula_patterns).alias("has_formula"),
        X.has_table(F.coalesce("html", F.lit(""))).alias("has_table"),
        X.has_list(F.coalesce("html", F.lit(""))).alias("has_list"),
        X.citation_matches(F.col("_lowered"), citation_patterns).alias("citation_matches"),
        X.example_values(F.col("_numbers")).alias("example_values"),
    )
    return sealed(prepared.withColumn("metrics", metrics).drop("_lowered", "_numbers"))
