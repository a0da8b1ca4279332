"""One Spark query per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as X
from contentgrade.functions import html as H
from contentgrade.functions import scores as SC
from contentgrade.functions import text as TX
from contentgrade.functions import urls as U
from contentgrade.functions.rounding import round2
from contentgrade.operators import (
    aggregates,
    attempts,
    classifier,
    frontier,
    labels,
    links,
    metrics,
    pages,
    regression,
    robots,
    scoring,
    tfidf,
)
from contentgrade.operators.calibration import learn_weights
from contentgrade.plans.evaluate import calibrate_weights, evaluate_pages, train_text_model
from contentgrade.schemas import FETCHES
from contentgrade.session import scratch_path
from contentgrade.sinks import reports
from contentgrade.sinks.weights import write_weights
from contentgrade.sources.fetches import read_fetches, stream_fetches
from contentgrade.sources.labels import read_labels, unique_labels
from contentgrade.sources.robots import latest_robots, parse_robots, robots_files, robots_rules
from contentgrade.sources.weights import read_weights
from contentgrade.streaming import evaluate as streaming

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

AGENT = "GradeBot/1.0"


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        REGISTRY[name] = function
        return function

    return register


def evaluated(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return evaluate_pages(
        X.fetches(spark, sf_dir),
        X.AS_OF,
        lexicon=X.LEXICON,
        citation_patterns=X.CITATIONS,
        keep=["page_id"],
        **options,
    )


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.parse_pages(pages.usable_fetches(X.fetches(spark, sf_dir)), keep=["page_id"])


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.extract_metrics(
        parsed(spark, sf_dir), lexicon=X.LEXICON, citation_patterns=X.CITATIONS
    )


def measured_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = X.documents(spark, sf_dir).withColumn("html", F.lit(""))
    return metrics.extract_metrics(documents, lexicon=X.LEXICON, citation_patterns=X.CITATIONS)


# Sources.


@query("read_fetches")
def _(spark, sf_dir):
    path = scratch_path(spark, "fetches")
    X.fetches(spark, sf_dir).withColumn("depth", F.lit(None).cast("int")).select(
        *FETCHES.fieldNames()
    ).write.parquet(path)
    return read_fetches(spark, path).select(
        "url", "status_code", F.length("html").cast("bigint").alias("html_chars"), "fetched_at", "error"
    )


@query("read_labels")
def _(spark, sf_dir):
    """Entries become arrays of at most a thousand, one file each, with invalid ones mixed in."""
    path = scratch_path(spark, "labels")
    entries = X.label_entries(spark, sf_dir).withColumn("bucket", F.floor(F.col("page_id") / 1000))
    as_json = F.to_json(F.struct("url", "target_score"))
    arrays = entries.groupBy("bucket").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("page_id", "pos", as_json.alias("j")))), lambda e: e["j"]),
            ", ",
        ).alias("body")
    )
    noise = F.lit('{"url": "", "target_score": 5}, "text", {"url": "https://none.example"}, ')
    arrays.select(F.concat(F.lit("["), noise, "body", F.lit("]")).alias("value"), "bucket").write.partitionBy(
        "bucket"
    ).text(path)
    return read_labels(spark, path).select("url_key", "url", "target_score")


@query("read_weights")
def _(spark, sf_dir):
    path = scratch_path(spark, "weights")
    part = X.table(spark, sf_dir, "part")
    size = F.col("p_size").cast("double")
    part.select(
        (size / 100).alias("accuracy"),
        F.when(F.col("p_partkey") % 3 == 0, size).alias("clarity"),
        F.col("p_name").alias("unknown"),
    ).write.json(path)
    return read_weights(spark, path, lines=True)


@query("robots_rules")
def _(spark, sf_dir):
    groups, _ = parse_robots(X.robots(spark, sf_dir))
    return robots_rules(groups).select(
        "host",
        F.col("group_no").cast("bigint").alias("group_no"),
        F.array_join("agents", ",").alias("agents"),
        F.col("seq").cast("bigint").alias("seq"),
        "allow",
        "path",
    )


@query("robots_hosts")
def _(spark, sf_dir):
    groups, sitemaps = parse_robots(X.robots(spark, sf_dir))
    delays = groups.groupBy("host").agg(F.max("crawl_delay").alias("crawl_delay"))
    return delays.join(sitemaps, "host", "left").select(
        "host", "crawl_delay", F.array_join("sitemaps", ",").alias("sitemaps")
    )


@query("robots_latest")
def _(spark, sf_dir):
    """The latest file of each host, parsed; every host has other rules."""
    files = robots_files(latest_robots(X.robots_fetches(spark, sf_dir)))
    rules = F.transform("rules", lambda r: F.concat_ws(" ", r["seq"].cast("string"), r["allow"].cast("string"), r["path"]))
    return files.select("host", F.array_join("sitemaps", ",").alias("sitemaps"), F.inline("groups")).select(
        "host",
        "sitemaps",
        F.col("group_no").cast("bigint").alias("group_no"),
        F.array_join("agents", ",").alias("agents"),
        "crawl_delay",
        F.array_join(rules, ",").alias("rules"),
    )


# Sinks.


@query("report_rows")
def _(spark, sf_dir):
    return reports.report_rows(evaluated(spark, sf_dir))


@query("csv_report")
def _(spark, sf_dir):
    path = scratch_path(spark, "report")
    reports.write_csv_report(evaluated(spark, sf_dir), path)
    schema = (
        "url string, title string, score double, classification string, accuracy double, "
        "transparency double, completeness double, freshness double, clarity double, "
        "word_count bigint, numeric_tokens bigint, has_formula boolean, has_table boolean, "
        "has_list boolean, citation_matches bigint, actuarial_terms string"
    )
    stored = spark.read.schema(schema).csv(path, header=True, escape='"')
    return stored.fillna({"actuarial_terms": "", "title": ""})


@query("nested_report")
def _(spark, sf_dir):
    nested = reports.nested_report(evaluated(spark, sf_dir))
    return nested.select(
        F.to_json(F.struct("page.url", "page.title", "page.metadata", "page.fetched_at"), {"ignoreNullFields": "false"}).alias("page"),
        F.col("score.classification").alias("classification"),
        F.col("metrics.word_count").alias("word_count"),
    )


@query("json_report")
def _(spark, sf_dir):
    path = scratch_path(spark, "report")
    results = evaluated(spark, sf_dir)
    reports.write_json_report(results, path)
    schema = reports.nested_report(results).schema
    stored = spark.read.schema(schema).json(path)
    return stored.select(
        F.col("page.url").alias("url"),
        F.col("page.metadata.author").alias("author"),
        F.col("page.metadata.published").alias("published"),
        F.col("page.fetched_at").alias("fetched_at"),
        F.col("metrics.word_count").alias("word_count"),
        reports.terms_text(F.col("metrics.actuarial_terms")).alias("terms"),
        F.col("score.composite").alias("composite"),
        F.col("score.classification").alias("classification"),
    )


@query("summary_file")
def _(spark, sf_dir):
    path = scratch_path(spark, "summary")
    reports.write_summary(evaluated(spark, sf_dir), path)
    return spark.read.schema("count bigint, average double, minimum double, maximum double").json(path)


@query("weights_file")
def _(spark, sf_dir):
    path = scratch_path(spark, "weights")
    write_weights(_lineitem_weights(spark, sf_dir), path, normalize=True)
    stored = read_weights(spark, path, lines=True)
    return stored.select(*[_six(F.col(name)).alias(name) for name in SC.COMPONENTS])


def _lineitem_weights(spark, sf_dir):
    rows = X.table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_quantity").alias("accuracy"),
        F.col("l_discount").alias("transparency"),
        F.col("l_tax").alias("completeness"),
        F.col("l_linenumber").cast("double").alias("freshness"),
        F.lit(1.0).alias("clarity"),
    )


def _six(value):
    """Six decimals, for values whose last bits depend on the engine."""
    return F.floor(value * 1e6 + 0.5) / 1e6


# Projections and filters.


@query("usable_fetches")
def _(spark, sf_dir):
    return pages.usable_fetches(X.fetches(spark, sf_dir)).select("page_id", "url", "status_code")


@query("normalize_url")
def _(spark, sf_dir):
    rows = X.table(spark, sf_dir, "pages")
    return rows.select("page_id", U.normalize_url(F.col("url")).alias("normal_url"))


@query("label_url_key")
def _(spark, sf_dir):
    rows = X.table(spark, sf_dir, "pages")
    padded = F.concat(F.lit(" \t"), F.col("url"), F.lit("// "))
    return rows.select("page_id", U.label_url_key(padded).alias("url_key"))


@query("same_site")
def _(spark, sf_dir):
    rows = X.table(spark, sf_dir, "pages")
    site = U.site_of("https://spam-farm.example.org/")
    return rows.filter(U.same_site(F.col("url"), F.lit(site))).select("page_id", "url")


@query("robots_allowed")
def _(spark, sf_dir):
    groups = robots_files(X.robots(spark, sf_dir))
    rows = X.table(spark, sf_dir, "pages").select("page_id", "url")
    allowed = robots.robots_allowed(rows, groups, "somebot")
    return allowed.select("page_id", "allowed")


@query("robots_allowed_named_agent")
def _(spark, sf_dir):
    groups = robots_files(X.robots(spark, sf_dir))
    rows = X.table(spark, sf_dir, "pages").select("page_id", "url")
    return robots.robots_allowed(rows, groups, AGENT).select("page_id", "allowed")


@query("effective_delay")
def _(spark, sf_dir):
    bodies = X.robots(spark, sf_dir)
    groups = robots_files(bodies)
    return robots.effective_delay(bodies.select("host"), groups, AGENT, 0.5).select("host", "delay")


@query("final_attempts")
def _(spark, sf_dir):
    log = X.attempt_log(spark, sf_dir)
    numbered = attempts.number_attempts(log, "at", "event_id")
    return attempts.final_attempts(numbered).select(
        "url", "event_id", F.col("attempt").cast("bigint").alias("attempt"), "outcome", "waited_seconds"
    )


@query("cached_fetch")
def _(spark, sf_dir):
    events = X.table(spark, sf_dir, "events")
    requests = events.select("event_id", F.col("user_id").alias("url"), F.col("ts").alias("requested_at"))
    stored = events.filter("event_type = 'view'").select(
        F.col("user_id").alias("url"), F.col("ts").alias("fetched_at")
    )
    answered = attempts.cached_fetch(requests, stored, ttl_seconds=3600)
    return answered.select(
        "event_id", "url", F.unix_micros("cached_at").alias("cached_micros")
    )


@query("cached_fetch_day")
def _(spark, sf_dir):
    events = X.table(spark, sf_dir, "events")
    requests = events.filter("event_type != 'view'").select(
        "event_id", F.col("user_id").alias("url"), F.col("ts").alias("requested_at")
    )
    stored = events.filter("event_type = 'view'").select(
        F.col("user_id").alias("url"), F.col("ts").alias("fetched_at"), "value"
    )
    answered = attempts.cached_fetch(requests, stored, ttl_seconds=86400, payload=["value"])
    return answered.select(
        "event_id", F.unix_micros("cached_at").alias("cached_micros"), "cached_value"
    )


@query("page_metadata")
def _(spark, sf_dir):
    rows = pages.page_metadata(parsed(spark, sf_dir))
    return rows.select("page_id", "metadata.language", "metadata.title", "metadata.url")


@query("parse_quality_flags")
def _(spark, sf_dir):
    rows = X.fetches(spark, sf_dir).withColumn(
        "html",
        F.when(F.col("page_id") % 5 == 0, F.regexp_replace("html", "(?is)<title>.*?</title>", "")).otherwise(
            F.col("html")
        ),
    )
    flagged = pages.parse_quality_flags(
        pages.parse_pages(pages.usable_fetches(rows), keep=["page_id"])
    )
    return flagged.select("page_id", "missing_title", "missing_text")


# HTML.


@query("html_title")
def _(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", "title")


@query("html_text")
def _(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("chars"))


@query("main_content")
def _(spark, sf_dir):
    """Pages without their body tags, so that article, main and div have to compete."""
    rows = X.fetches(spark, sf_dir).withColumn(
        "html", F.regexp_replace("html", "(?i)</?body[^>]*>", "")
    )
    texts = pages.parse_pages(pages.usable_fetches(rows), keep=["page_id"])
    return texts.select("page_id", F.md5("text").alias("text_md5"))


@query("meta_by_name")
def _(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", "metadata.description", "metadata.author")


@query("meta_datetime")
def _(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", "metadata.published", "metadata.modified")


@query("fetched_timestamp")
def _(spark, sf_dir):
    rows = X.fetches(spark, sf_dir)
    moment = pages.fetched_timestamp(F.col("fetched_at") + F.lit(0.25))
    return rows.select("page_id", reports.iso_text(moment).alias("fetched_at"))


@query("parse_filtered")
def _(spark, sf_dir):
    rows = parsed(spark, sf_dir).filter("title != '' and text like '%the%' and length(text) > 500")
    return rows.select("url", "title", F.md5("text").alias("text_md5"))


@query("parse_pages")
def _(spark, sf_dir):
    return parsed(spark, sf_dir).select(
        "url",
        "title",
        F.md5("text").alias("text_md5"),
        F.length("html").cast("bigint").alias("html_chars"),
        "metadata.author",
        "metadata.published",
    )


@query("extract_links")
def _(spark, sf_dir):
    return links.extract_links(pages.usable_fetches(X.fetches(spark, sf_dir)))


# Link graph.


@query("crawl_frontier")
def _(spark, sf_dir):
    found = frontier.crawl_frontier(
        X.fixture_links(spark, sf_dir), X.first_page(spark, sf_dir)
    )
    return found.select("url", F.col("depth").cast("bigint").alias("depth"), "referer", "order")


@query("crawl_budget")
def _(spark, sf_dir):
    """A budget of half the pages, which ends inside a level."""
    budget = X.page_urls(spark, sf_dir).count() // 2
    found = frontier.crawl_frontier(X.fixture_links(spark, sf_dir), _seed_pages(spark, sf_dir), max_pages=budget)
    return found.select("url", F.col("depth").cast("bigint").alias("depth"), "referer", "order")


@query("crawl_frontier_rules")
def _(spark, sf_dir):
    """Failed pages are reached but not expanded, and robots rules leave pages out."""
    groups = robots_files(X.robots(spark, sf_dir))
    found = frontier.crawl_frontier(
        X.fixture_links(spark, sf_dir),
        _seed_pages(spark, sf_dir),
        fetches=X.fetches(spark, sf_dir, rich=False),
        groups=groups,
        agent="somebot",
    )
    return found.select("url", F.col("depth").cast("bigint").alias("depth"), "referer", "order")


def _seed_pages(spark, sf_dir):
    return X.page_urls(spark, sf_dir).filter(F.contains("page_url", F.lit("//blog."))).select("page_url")


@query("crawl_visits")
def _(spark, sf_dir):
    """The traversal that does not merge repeated discoveries of a level."""
    found = frontier.crawl_frontier(
        X.fixture_links(spark, sf_dir),
        _seed_pages(spark, sf_dir),
        max_depth=2,
        max_pages=None,
        dedupe=False,
    )
    return found.select("url", F.col("depth").cast("bigint").alias("depth"), "referer", "visits")


@query("page_budget")
def _(spark, sf_dir):
    """A tenth of the pages, in an order of pretended depths."""
    rows = X.page_urls(spark, sf_dir)
    budget = rows.count() // 10
    leveled = rows.select(
        F.col("page_url").alias("url"), (F.col("page_id") % 50).cast("int").alias("depth")
    )
    kept = frontier.page_budget(leveled, budget)
    return kept.select("url", F.col("depth").cast("bigint").alias("depth"))


# Text metrics.


@query("word_count")
def _(spark, sf_dir):
    return measured_documents(spark, sf_dir).select("doc_id", "metrics.word_count")


@query("term_counts")
def _(spark, sf_dir):
    rows = measured_documents(spark, sf_dir)
    return rows.select("doc_id", reports.terms_text(F.col("metrics.actuarial_terms")).alias("terms"))


@query("domain_term_counts")
def _(spark, sf_dir):
    rows = X.fetches(spark, sf_dir).select("page_id", F.lower("html").alias("html"))
    return rows.select("page_id", reports.terms_text(TX.term_counts(F.col("html"))).alias("terms"))


@query("numeric_tokens")
def _(spark, sf_dir):
    return measured_documents(spark, sf_dir).select("doc_id", "metrics.numeric_tokens")


@query("example_values")
def _(spark, sf_dir):
    rows = measured_documents(spark, sf_dir)
    return rows.select("doc_id", F.posexplode("metrics.example_values").alias("pos", "value")).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "value"
    )


@query("has_formula")
def _(spark, sf_dir):
    return measured_documents(spark, sf_dir).select("doc_id", "metrics.has_formula")


@query("has_table_and_list")
def _(spark, sf_dir):
    return measured(spark, sf_dir).select("page_id", "metrics.has_table", "metrics.has_list")


@query("citation_matches")
def _(spark, sf_dir):
    return measured_documents(spark, sf_dir).select("doc_id", "metrics.citation_matches")


@query("extract_metrics")
def _(spark, sf_dir):
    return measured(spark, sf_dir).select(
        "page_id",
        "metrics.word_count",
        "metrics.numeric_tokens",
        "metrics.has_formula",
        "metrics.has_table",
        "metrics.has_list",
        "metrics.citation_matches",
        reports.terms_text(F.col("metrics.actuarial_terms")).alias("terms"),
    )


# Scores.


def _component(name: str) -> Query:
    def run(spark, sf_dir):
        rows = scoring.compute_components(measured(spark, sf_dir), X.AS_OF)
        return rows.select("page_id", _six(F.col(f"components.{name}")).alias(name))

    return run


for _name in ("accuracy", "transparency", "completeness", "clarity"):
    REGISTRY[f"score_{_name}"] = _component(_name)


@query("score_freshness")
def _(spark, sf_dir):
    rows = X.dated_orders(spark, sf_dir)
    dated = rows.withColumn("parsed", SC.iso_timestamp(F.col("moment")))
    as_of = SC.as_of_column("2001-01-01T00:00:00+00:00")
    return dated.select(
        "o_orderkey", _six(SC.freshness(F.col("moment"), F.col("parsed"), as_of)).alias("freshness")
    )


@query("compute_components")
def _(spark, sf_dir):
    rows = scoring.compute_components(measured(spark, sf_dir), X.AS_OF)
    return rows.select(
        "page_id", *[_six(F.col(f"components.{n}")).alias(n) for n in SC.COMPONENTS]
    )


@query("normalize_weights")
def _(spark, sf_dir):
    rows = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    weights = F.struct(
        F.col("l_quantity").alias("accuracy"),
        F.col("l_discount").alias("transparency"),
        F.col("l_tax").alias("completeness"),
        F.col("l_linenumber").cast("double").alias("freshness"),
        F.lit(1.0).alias("clarity"),
    )
    normal = rows.withColumn("w", SC.normalize_weights(weights))
    return normal.select(
        "l_orderkey",
        F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        *[_six(F.col(f"w.{name}")).alias(name) for name in SC.COMPONENTS],
    )


@query("apply_weights")
def _(spark, sf_dir):
    rows = scoring.compute_components(measured(spark, sf_dir), X.AS_OF)
    weighted = scoring.apply_weight_sets(rows, X.WEIGHT_SETS)
    return weighted.select("page_id", "weight_set", _six(F.col("composite")).alias("composite"))


@query("classify")
def _(spark, sf_dir):
    orders = X.table(spark, sf_dir, "orders")
    score = F.col("o_totalprice") / 5000.0
    return orders.select("o_orderkey", SC.classify(score).alias("classification"))


@query("round_scores")
def _(spark, sf_dir):
    """Two-decimal rounding over values that are full of ties."""
    rows = X.table(spark, sf_dir, "lineitem")
    value = F.col("l_extendedprice") / 1000.0
    return rows.select(
        "l_orderkey",
        F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        round2(value).alias("rounded"),
        round2(F.col("l_quantity") / 8.0 + F.col("l_linenumber") / 1000.0).alias("near_tie"),
    )


@query("score_heuristic")
def _(spark, sf_dir):
    rows = evaluated(spark, sf_dir)
    return rows.select(
        "page_id",
        "score.composite",
        "score.classification",
        *[F.col(f"score.components.{n}").alias(n) for n in SC.COMPONENTS],
    )


@query("score_predicted")
def _(spark, sf_dir):
    rows = measured(spark, sf_dir).withColumn("predicted_score", X.predicted_score())
    return scoring.score_predicted(rows).select(
        "page_id",
        "score.composite",
        "score.classification",
        "score.components.accuracy",
        "score.components.ml_score",
    )


@query("score_hybrid")
def _(spark, sf_dir):
    rows = evaluated(spark, sf_dir).withColumn("predicted_score", X.predicted_score())
    return scoring.score_hybrid(rows).select(
        "page_id",
        "score.composite",
        "score.classification",
        "score.components.accuracy",
        "score.components.ml_score",
    )


@query("evaluate_pages")
def _(spark, sf_dir):
    rows = evaluated(spark, sf_dir)
    return rows.select(
        "url",
        "title",
        F.md5("text").alias("text_md5"),
        "metrics.word_count",
        "score.composite",
        "score.classification",
    )


def _good(rows: DataFrame) -> DataFrame:
    good = (F.col("score.composite") >= 35) & (F.col("score.classification") != "Discreto")
    return rows.filter(good & (F.col("metrics.word_count") > 60) & F.col("text").contains("the"))


@query("evaluate_filtered")
def _(spark, sf_dir):
    """What users keep: pages above a composite, of some classes and long enough."""
    return _good(evaluated(spark, sf_dir)).select("url", "score.composite", "score.classification", "metrics.word_count")


@query("evaluate_stream_filtered")
def _(spark, sf_dir):
    path = scratch_path(spark, "streamed-filtered")
    rows = _good(_streamed(spark, sf_dir)).select("url", "score.composite", "score.classification", "metrics.word_count")
    streaming.write_results(rows, path, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(path)


@query("evaluate_pages_defaults")
def _(spark, sf_dir):
    """The default lexicon and citation patterns."""
    rows = evaluate_pages(X.fetches(spark, sf_dir), X.AS_OF, keep=["page_id"])
    return rows.select(
        "page_id",
        "metrics.citation_matches",
        reports.terms_text(F.col("metrics.actuarial_terms")).alias("terms"),
        "score.composite",
        "score.classification",
    )


# Aggregates.


@query("summary")
def _(spark, sf_dir):
    return aggregates.summary(evaluated(spark, sf_dir))


@query("top_pages")
def _(spark, sf_dir):
    return aggregates.top_pages(evaluated(spark, sf_dir), 5).select("url", "score.composite")


@query("regression_metrics")
def _(spark, sf_dir):
    rows = X.table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 1500.0).alias("estimate")
    )
    found = aggregates.regression_metrics(rows)
    return found.select(
        *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "r2")],
        *[(F.round(F.col(c) / 1e6, 2)).alias(c) for c in ("ss_res", "ss_tot")],
    )


@query("classifier_metrics")
def _(spark, sf_dir):
    rows = evaluated(spark, sf_dir).withColumn("predicted_score", X.predicted_score())
    actual = classifier.midpoint(classifier.bin_scores(F.col("score.composite")))
    return aggregates.classifier_metrics(rows.withColumn("target_score", actual))


# Labels and learning.


@query("match_labels")
def _(spark, sf_dir):
    found = labels.match_labels(
        X.fetches(spark, sf_dir), unique_labels(X.label_entries(spark, sf_dir))
    )
    return found.select("page_id", "url", "target_score")


@query("prepare")
def _(spark, sf_dir):
    rows = X.table(spark, sf_dir, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").alias("k"),
        F.when(F.col("event_id") % 6 == 0, F.col("event_type"))
        .otherwise(F.col("value").cast("string"))
        .alias("mixed"),
        F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("value"),
    )
    return regression.prepare(rows, "value", ["k", "mixed"], keep=["event_id"])


@query("split_exact")
def _(spark, sf_dir):
    rows = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    train, test = regression.split(rows, ["l_orderkey", "l_linenumber"], 0.2, seed=7)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "part")


@query("split_by_range")
def _(spark, sf_dir):
    rows = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    train, test = regression.split(rows, ["l_orderkey", "l_linenumber"], 0.2, seed=7, exact=False)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "part")


@query("fit_ols")
def _(spark, sf_dir):
    rows = X.table(spark, sf_dir, "lineitem")
    fit = regression.fit_ols(rows, "l_extendedprice", ["l_quantity"])
    return rows.agg(F.count("*").alias("samples")).select(
        F.round(F.lit(fit.intercept), 3).alias("intercept"),
        F.round(F.lit(fit.coefficients["l_quantity"]), 3).alias("slope"),
        "samples",
    )


@query("fit_evaluate")
def _(spark, sf_dir):
    rows = X.table(spark, sf_dir, "lineitem")
    found = regression.fit_evaluate(
        rows, "l_extendedprice", ["l_quantity"], key=["l_orderkey", "l_linenumber"], seed=7
    )
    return found.select(
        F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"), F.round("r2", 5).alias("r2")
    )


@query("fit_evaluate_many")
def _(spark, sf_dir):
    rows = X.table(spark, sf_dir, "lineitem")
    found = regression.fit_evaluate(
        rows,
        "l_extendedprice",
        ["l_quantity", "l_discount", "l_tax", "l_linenumber"],
        key=["l_orderkey", "l_linenumber"],
    )
    return found.select(F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"), F.round("r2", 5).alias("r2"))


@query("learn_weights")
def _(spark, sf_dir):
    results = evaluated(spark, sf_dir)
    found = learn_weights(results, unique_labels(X.label_entries(spark, sf_dir)))
    weights = found.weights.as_dict()
    counted = results.agg(F.count("*").alias("pages"))
    return counted.select(
        *[F.round(F.lit(value), 6).alias(name) for name, value in weights.items()],
        F.round(F.lit(found.mae), 6).alias("mae"),
        F.round(F.lit(found.mse), 6).alias("mse"),
        F.lit(found.samples).cast("bigint").alias("samples"),
        "pages",
    )


@query("calibrate_weights")
def _(spark, sf_dir):
    entries = unique_labels(X.label_entries(spark, sf_dir))
    found = calibrate_weights(
        X.fetches(spark, sf_dir),
        entries,
        X.AS_OF,
        lexicon=X.LEXICON,
        citation_patterns=X.CITATIONS,
    )
    return entries.agg(F.count("*").alias("labels")).select(
        *[F.round(F.lit(value), 6).alias(name) for name, value in found.weights.as_dict().items()],
        F.lit(found.samples).cast("bigint").alias("samples"),
        "labels",
    )


@query("bin_scores")
def _(spark, sf_dir):
    orders = X.table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey",
        classifier.bin_scores(F.col("o_totalprice") / 5000.0).cast("bigint").alias("bin"),
    )


@query("fit_tfidf")
def _(spark, sf_dir):
    vocabulary = tfidf.fit_tfidf(X.documents(spark, sf_dir), stop_words=X.STOP_WORDS)
    rows = spark.createDataFrame(vocabulary.rows(), tfidf.ROW_SCHEMA)
    return rows.select("term", "corpus_count", "document_count", _six(F.col("idf")).alias("idf"))


@query("tfidf_transform")
def _(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    documents = X.documents(spark, sf_dir)
    vocabulary = tfidf.fit_tfidf(documents, stop_words=X.STOP_WORDS)
    vectors = tfidf.tfidf_transform(documents, vocabulary)
    terms = F.array(*[F.lit(term) for term in vocabulary.terms])
    weights = F.arrays_zip(terms.alias("term"), vector_to_array("features").alias("weight"))
    return (
        vectors.select("doc_id", F.inline(weights))
        .toDF("doc_id", "term", "weight")
        .filter("weight > 0")
        .select("doc_id", "term", _six(F.col("weight")).alias("weight"))
    )


@query("fit_classifier")
def _(spark, sf_dir):
    rows = X.text_labels(spark, sf_dir)
    found = classifier.fit_classifier(rows, key=["doc_id"], stop_words=X.STOP_WORDS)
    return rows.agg(F.count("*").alias("labelled")).select(
        F.lit(found.mae).alias("mae"),
        F.lit(found.mse).alias("mse"),
        F.lit(found.train_samples).cast("bigint").alias("train_samples"),
        F.lit(found.test_samples).cast("bigint").alias("test_samples"),
        "labelled",
    )


@query("predict_scores")
def _(spark, sf_dir):
    found = classifier.fit_classifier(X.text_labels(spark, sf_dir), key=["doc_id"], stop_words=X.STOP_WORDS)
    predicted = classifier.predict_scores(found.model, X.documents(spark, sf_dir))
    return predicted.select("doc_id", "predicted_class", "predicted_score")


@query("stored_model")
def _(spark, sf_dir):
    """Scores of a model that was written and read back."""
    path = scratch_path(spark, "model")
    found = classifier.fit_classifier(X.text_labels(spark, sf_dir), key=["doc_id"], stop_words=X.STOP_WORDS)
    classifier.save_model(found.model, path)
    predicted = classifier.predict_scores(
        classifier.load_model(spark, path), X.documents(spark, sf_dir)
    )
    return predicted.select("doc_id", "predicted_class", "predicted_score")


@query("train_text_model")
def _(spark, sf_dir):
    found = train_text_model(
        X.fetches(spark, sf_dir), unique_labels(X.label_entries(spark, sf_dir)), stop_words=X.STOP_WORDS
    )
    evaluated_ml = evaluate_pages(
        X.fetches(spark, sf_dir), X.AS_OF, mode="ml", model=found.model, keep=["page_id"]
    )
    return evaluated_ml.select("page_id", "score.composite", "score.classification")


@query("evaluate_hybrid")
def _(spark, sf_dir):
    found = train_text_model(
        parsed(spark, sf_dir), unique_labels(X.label_entries(spark, sf_dir)), stop_words=X.STOP_WORDS
    )
    return evaluated(spark, sf_dir, mode="hybrid", model=found.model).select(
        "page_id", "score.composite", "score.classification", "score.components.ml_score"
    )


# Streaming.


def _streamed(spark, sf_dir):
    source = scratch_path(spark, "fetches")
    X.fetches(spark, sf_dir).withColumn("depth", F.lit(None).cast("int")).select(
        *FETCHES.fieldNames()
    ).write.parquet(source)
    return streaming.evaluate_stream(
        stream_fetches(spark, source, max_files_per_trigger=4),
        X.AS_OF,
        lexicon=X.LEXICON,
        citation_patterns=X.CITATIONS,
    )


@query("evaluate_stream")
def _(spark, sf_dir):
    path = scratch_path(spark, "streamed")
    results = _streamed(spark, sf_dir).select("url", "title", "score.composite", "score.classification")
    streaming.write_results(results, path, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(path)


@query("summary_stream")
def _(spark, sf_dir):
    path = scratch_path(spark, "totals")
    totals = streaming.summary_stream(_streamed(spark, sf_dir))
    streaming.write_summary(totals, path, scratch_path(spark, "progress")).awaitTermination()
    return streaming.read_summary(spark, path)
