"""Reports over evaluated pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentgrade.functions.scores import COMPONENTS
from contentgrade.operators.aggregates import summary


def terms_text(terms: Column) -> Column:
    """``term:count`` pairs, sorted by term and joined by ``"; "``."""
    pairs = F.array_sort(F.map_entries(terms))
    return F.array_join(
        F.transform(pairs, lambda pair: F.concat_ws(":", pair["key"], pair["value"].cast("string"))),
        "; ",
    )


def report_rows(results: DataFrame) -> DataFrame:
    """The flat report: sixteen columns in fixed order."""
    return results.select(
        "url",
        "title",
        F.col("score.composite").alias("score"),
        F.col("score.classification").alias("classification"),
        *[F.col(f"score.components.{name}").alias(name) for name in COMPONENTS],
        "metrics.word_count",
        "metrics.numeric_tokens",
        "metrics.has_formula",
        "metrics.has_table",
        "metrics.has_list",
        "metrics.citation_matches",
        terms_text(F.col("metrics.actuarial_terms")).alias("actuarial_terms"),
    )


def iso_text(moment: Column) -> Column:
    """Timestamp to ISO 8601 text in UTC, whatever the session's zone; microseconds if any."""
    utc = F.to_utc_timestamp(moment, F.current_timezone())
    plain = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(moment), F.lit(1_000_000))
    fraction = F.when(micros == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))
    )
    return F.concat(plain, fraction, F.lit("+00:00"))


def nested_report(results: DataFrame) -> DataFrame:
    """``page, metrics, score`` without text and html."""
    return results.select(
        F.struct(
            "url", "title", "metadata", iso_text(F.col("fetched_at")).alias("fetched_at")
        ).alias("page"),
        "metrics",
        "score",
    )


def write_csv_report(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the flat report as CSV with a header, one file per partition."""
    report_rows(results).write.mode(mode).csv(path, header=True, escape='"')


def write_json_report(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the nested report as JSON lines; nulls are kept."""
    nested_report(results).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_summary(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the summary as one JSON object."""
    summary(results).write.mode(mode).json(path)
