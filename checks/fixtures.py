"""Inputs for the registered queries, all derived from the given tables.

Each function has a counterpart with the same rule in :mod:`checks.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentgrade.functions.scores import Weights
from contentgrade.functions.text import WORD
from contentgrade.functions.urls import netloc, normalize_url
from contentgrade.sources.fetches import spread

AS_OF = "2024-06-01T00:00:00+00:00"
LEXICON = ("the", "ation", "heit", "ción", "que", "license")
CITATIONS = (
    rf"license(?<!{WORD}license)(?!{WORD})",
    rf"the\s+of(?<!{WORD}the\s{{1,9}}of)(?!{WORD})",
    rf"que(?<!{WORD}que)",
    "heit",
    rf"ción(?!{WORD})",
)
STOP_WORDS = ("the", "of", "and", "to", "de", "la", "que", "der", "die", "und", "el", "les")
WEIGHT_SETS = {
    "default": Weights(),
    "doubled": Weights(2.0, 1.0, 1.0, 0.5, 0.5),
    "accuracy": Weights(1.0, 0.0, 0.0, 0.0, 0.0),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rich_html() -> Column:
    """Page html with dates, authors and tables added by page number."""
    page = F.col("page_id")
    date = F.date_format(F.date_add(F.lit("2022-06-01").cast("date"), (page % 900).cast("int")), "yyyy-MM-dd")
    head = (
        F.when(
            page % 4 == 0,
            F.concat(
                F.lit('<head><meta name="author" content=" Autore &amp; Co "><META content="'),
                date,
                F.lit('T10:00:00Z" property="article:published_time">'),
            ),
        )
        .when(
            page % 4 == 1,
            F.concat(
                F.lit("<head><meta property='article:modified_time' content='"),
                date,
                F.lit("'><meta name=\"description\" content=\"Una pagina\"><meta name=\"description\" content=\"x\">"),
            ),
        )
        .when(
            page % 4 == 2,
            F.concat(
                F.lit('<head><meta name="author" content=""><time class="a" datetime="'),
                date,
                F.lit('T01:30:00+01:00">t</time>'),
            ),
        )
        .otherwise(F.lit("<head>"))
    )
    table_part = F.when(
        page % 3 == 0,
        F.concat(
            F.lit("<article><table><tr><td>1,5 = "),
            (page % 97).cast("string"),
            F.lit(".25</td><td>3x 1,250,000</td></tr></table><ol><li>license</li></ol>"),
        ),
    ).otherwise(F.lit("<article>"))
    with_head = F.replace(F.col("html"), F.lit("<head>"), head)
    return F.replace(with_head, F.lit("<article>"), table_part)


def fetches(spark: SparkSession, sf_dir: str, rich: bool = True) -> DataFrame:
    """The pages as fetch outcomes; every eleventh fetch failed."""
    pages = spread(table(spark, sf_dir, "pages"))
    failed = F.col("page_id") % 11 == 0
    html = rich_html() if rich else F.col("html")
    return pages.select(
        "page_id",
        "url",
        F.when(~failed, F.lit(200)).alias("status_code"),
        F.when(failed, F.lit("")).otherwise(html).alias("html"),
        (F.col("page_id") + 1704067200).cast("double").alias("fetched_at"),
        F.lit(None).cast("string").alias("referer"),
        F.when(failed, F.lit("Timeout")).alias("error"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers with their normal url; of equal urls the smallest number stays."""
    pages = table(spark, sf_dir, "pages")
    return pages.groupBy(normalize_url(F.col("url")).alias("page_url")).agg(
        F.min("page_id").alias("page_id")
    )


def fixture_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ``i`` links to ``(7i + 1) mod n`` and ``(3i + 2) mod n``."""
    n = table(spark, sf_dir, "pages").count()
    urls = page_urls(spark, sf_dir)
    page = F.col("page_id")
    targets = F.explode(F.array((page * 7 + 1) % n, (page * 3 + 2) % n))
    edges = urls.select(F.col("page_url").alias("src_url"), targets.alias("page_id"))
    return edges.join(urls.withColumnRenamed("page_url", "dst_url").hint("merge"), "page_id").select(
        "src_url", "dst_url"
    )


def first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_urls(spark, sf_dir).filter("page_id = 0").select("page_url")


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robots.txt per host of the pages; about half of the hosts have none."""
    hosts = table(spark, sf_dir, "pages").select(netloc(F.col("url")).alias("host")).distinct()
    has_rules = F.substring(F.md5("host"), 1, 1) < "8"
    body = F.lit(
        "# crawl rules\nUser-agent: *\nAllow: /en/1\nDisallow: /en/ # rest\nCrawl-delay: 2\n\n"
        "User-agent: other\nUser-agent: gradebot\nDisallow: /fr/\nDisallow:\n\n"
        "Disallow: /de/\nSitemap: https://maps.example/s.xml\n"
    )
    return hosts.select(
        "host",
        F.when(has_rules, F.lit(200)).otherwise(F.lit(404)).alias("status_code"),
        F.when(has_rules, body).otherwise(F.lit("")).alias("body"),
    )


def robots_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fetch of the host's robots.txt per page, no two of one body, some of them failed."""
    digits = F.md5("url")

    def line(i: Column) -> Column:
        def at(length: int) -> Column:
            return F.substring(digits, i + 1, F.lit(length))

        digit = F.substring(digits, i, F.lit(1))
        return (
            F.when(digit.isin("0", "1"), F.lit("User-agent: *"))
            .when(digit.isin("2", "3"), F.concat(F.lit("user-agent : bot"), at(1)))
            .when(digit.isin("4", "5"), F.concat(F.lit("Disallow: /"), at(2), F.lit(" # rest")))
            .when(digit.isin("6", "7"), F.concat(F.lit("ALLOW:/"), at(3)))
            .when(digit == "8", F.concat(F.lit("Crawl-delay: "), i.cast("string")))
            .when(digit == "9", F.lit("Crawl-delay: soon"))
            .when(digit.isin("a", "b"), F.lit(""))
            .when(digit == "c", F.lit("# note"))
            .when(digit == "d", F.concat(F.lit("Sitemap: https://maps.example/"), i.cast("string")))
            .otherwise(F.lit("Disallow:"))
        )

    lines = F.transform(F.sequence(F.lit(1), F.lit(28)), line)
    return table(spark, sf_dir, "pages").select(
        netloc(F.col("url")).alias("host"),
        F.when(F.substring(digits, 32, 1) < "2", F.lit(404)).otherwise(F.lit(200)).alias("status_code"),
        F.concat(F.lit("User-agent: *\n"), F.array_join(lines, "\n")).alias("body"),
        F.col("page_id").alias("fetched_at"),
    )


def attempt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fetch attempts of the user's url."""
    events = table(spark, sf_dir, "events")
    outcome = (
        F.when(F.col("event_type") == "error", F.lit("timeout"))
        .when(F.col("event_type") == "view", F.lit("http"))
        .otherwise(F.lit("ok"))
    )
    return events.select(
        F.col("user_id").alias("url"), F.col("ts").alias("at"), "event_id", outcome.alias("outcome")
    )


def label_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels for all pages under a rewritten url, some of them twice, and one for a page that isn't there."""
    pages = table(spark, sf_dir, "pages")
    rewritten = F.concat(F.regexp_replace("url", "^https://", "http://"), F.lit("/"))
    score = (F.lit(40) + F.col("page_id") % 60).cast("double")
    once = pages.select(
        "page_id", rewritten.alias("url"), score.alias("target_score"), F.col("page_id").cast("int").alias("pos")
    )
    no_page = [(-1, "http://nowhere.example/", 50.0, -1)]
    once = once.unionByName(spark.createDataFrame(no_page, "page_id long, url string, target_score double, pos int"))
    again = once.filter("page_id % 9 = 0").select(
        "page_id", "url", (F.col("target_score") + 1.0).alias("target_score"), (F.col("pos") + 1).alias("pos")
    )
    return once.unionByName(again)


def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a score from their quality label."""
    labels = table(spark, sf_dir, "labels")
    score = F.when(F.col("quality") == 1, F.lit(85.0)).otherwise(F.lit(40.0))
    return (
        documents(spark, sf_dir)
        .join(labels.select("doc_id", score.alias("target_score")), "doc_id")
        .select("doc_id", "text", "target_score")
    )


def predicted_score() -> Column:
    """A stand-in prediction that cycles through the class midpoints."""
    return F.element_at(
        F.array(*[F.lit(v) for v in (25.0, 60.0, 77.5, 92.5)]), (F.col("page_id") % 4 + 1).cast("int")
    )


def dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as text, some missing and some unreadable."""
    orders = table(spark, sf_dir, "orders")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    key = F.col("o_orderkey")
    moment = (
        F.when(key % 7 == 0, F.lit(None).cast("string")).when(key % 13 == 0, F.lit("n/a")).otherwise(iso)
    )
    return orders.select("o_orderkey", moment.alias("moment"))
