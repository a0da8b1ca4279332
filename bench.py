"""Time the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (tables), ``BENCH_CPUS`` (cores). Each query is built from the
tables and run to the end in a fresh plan; the first run warms up, the best of two counts.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as X
from contentgrade.functions.urls import normalize_url
from contentgrade.operators import aggregates, attempts, regression, tfidf
from contentgrade.operators.frontier import crawl_frontier
from contentgrade.operators.labels import match_labels
from contentgrade.operators.links import extract_links
from contentgrade.operators.metrics import extract_metrics
from contentgrade.operators.pages import parse_pages, usable_fetches
from contentgrade.operators.robots import robots_allowed
from contentgrade.plans.evaluate import evaluate_pages
from contentgrade.session import local_session
from contentgrade.sinks.reports import report_rows
from contentgrade.sources.labels import unique_labels
from contentgrade.sources.robots import parse_robots


def parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_pages(usable_fetches(X.fetches(spark, sf_dir, rich=False)))


def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.summary(evaluate_pages(X.fetches(spark, sf_dir, rich=False), X.AS_OF))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_rows(evaluate_pages(X.fetches(spark, sf_dir, rich=False), X.AS_OF))


def document_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = X.documents(spark, sf_dir).withColumn("html", F.lit(""))
    return extract_metrics(documents).select("doc_id", "metrics")


def tfidf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = X.documents(spark, sf_dir)
    vocabulary = tfidf.fit_tfidf(documents)
    return tfidf.tfidf_transform(documents, vocabulary).select("doc_id", "features")


def links_and_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = extract_links(X.fetches(spark, sf_dir, rich=False)).select(
        normalize_url(F.col("src_url")).alias("src_url"), "dst_url"
    )
    links = own.unionByName(X.fixture_links(spark, sf_dir))
    return crawl_frontier(links, X.first_page(spark, sf_dir), max_depth=3, max_pages=None)


def least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regression.fit_evaluate(
        X.table(spark, sf_dir, "lineitem"),
        "l_extendedprice",
        ["l_quantity", "l_discount", "l_tax", "l_linenumber"],
        key=["l_orderkey", "l_linenumber"],
    )


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, _ = parse_robots(X.robots(spark, sf_dir))
    rows = X.table(spark, sf_dir, "pages").select("page_id", "url")
    return robots_allowed(rows, groups, "gradebot")


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = X.table(spark, sf_dir, "events")
    url = F.col("user_id").alias("url")
    requests = events.filter("event_type != 'view'").select("event_id", url, F.col("ts").alias("requested_at"))
    stored = events.filter("event_type = 'view'").select(url, F.col("ts").alias("fetched_at"))
    return attempts.cached_fetch(requests, stored)


def retry_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = attempts.number_attempts(X.attempt_log(spark, sf_dir), "at", "event_id")
    return attempts.final_attempts(numbered)


def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetches = X.fetches(spark, sf_dir, rich=False).drop("html")
    return match_labels(fetches, unique_labels(X.label_entries(spark, sf_dir)))


HEADLINE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "parse_pages": (parse, "pages"),
    "evaluate_summary": (evaluate, "pages"),
    "evaluate_report": (report, "pages"),
    "document_metrics": (document_metrics, "documents"),
    "tfidf_fit_transform": (tfidf_documents, "documents"),
    "links_and_frontier": (links_and_frontier, "pages"),
    "least_squares": (least_squares, "lineitem"),
    "robots_allowed": (robots, "pages"),
    "cached_fetch": (cache_lookup, "events"),
    "final_attempts": (retry_policy, "events"),
    "match_labels": (label_join, "pages"),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    rates: dict[str, float] = {}
    for name, (query, table) in HEADLINE.items():
        times = []
        for _ in range(3):
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:]), 3)
        rates[name] = round(X.table(spark, sf_dir, table).count() / seconds[name], 1)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_second": rates,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
