"""Breadth-first traversal of a stored link graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentgrade.functions.urls import normalize_url
from contentgrade.operators.pages import usable_fetches
from contentgrade.operators.robots import apply_rules, index_rules
from contentgrade.operators.skew import numbered
from contentgrade.session import scratch_path, shared_dir
from contentgrade.sources.robots import agent_rules

def _seed_frame(spark: SparkSession, seeds: Sequence[str] | DataFrame) -> DataFrame:
    frame = (
        seeds.select(F.col(seeds.columns[0]).alias("url"))
        if isinstance(seeds, DataFrame)
        else spark.createDataFrame([(seed,) for seed in seeds], "url string")
    )
    return frame.select(normalize_url(F.col("url")).alias("url")).distinct()


def crawl_frontier(
    links: DataFrame,
    seeds: Sequence[str] | DataFrame,
    fetches: DataFrame | None = None,
    groups: DataFrame | None = None,
    agent: str = "*",
    max_depth: int | None = None,
    max_pages: int | None = None,
    dedupe: bool = True,
    salts: int = 8,
) -> DataFrame:
    """``url, depth, referer, visits, order`` of the pages that a crawl from the seeds would visit.

    ``links`` has ``src_url, dst_url`` in normal form. With ``fetches``, only pages whose
    fetch was usable are expanded. With ``groups`` of robots rules, urls that ``agent`` may
    not visit are left out. The referer is the smallest url among the pages of the level
    before that link here, so the result does not depend on timing. ``order`` numbers the
    pages from 0 without gaps by depth, url and referer.

    One join per level. The links are cut to expandable pages, made distinct and written once,
    as a table in buckets by source, to the shared folder; a level joins them in place, from any
    executor, and shuffles its own rows, and the urls seen before to leave those out. A page with very
    many links is spread over ``salts`` buckets. Candidates are combined per target before they
    move, which keeps a page that everyone links to small. Each level is checkpointed, which
    ends its lineage. No level is broadcast, so the driver sees a count per level, not its urls.

    Without ``dedupe`` a url that several pages of one level link to is visited once per
    link. Those visits come as the count ``visits`` per url and referer, not as repeated
    rows, and multiply on the way down as the visits themselves would. Such a crawl needs a
    depth, as loops never end, and takes no page budget.

    Neither depth nor pages are limited unless a limit is given.
    """
    if not dedupe and (max_pages is not None or max_depth is None):
        raise ValueError("a crawl without merging needs a depth and takes no page budget")
    spark = links.sparkSession
    shared_dir(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("dst_url"), F.lit(salts)).cast("int")
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    edges = links.select("src_url", "dst_url").distinct().withColumn("salt", salt)
    if fetches is not None:
        alive = usable_fetches(fetches).select(normalize_url(F.col("url")).alias("src_url"))
        expandable = alive.distinct().withColumn("salt", every_salt)
        edges = edges.join(expandable.hint("merge"), ["src_url", "salt"], "left_semi")
    name = _bucketed(edges, partitions)
    edges = spark.table(name)

    rules = None if groups is None else index_rules(agent_rules(groups, agent)).checkpoint()

    def permitted(level: DataFrame) -> DataFrame:
        if rules is None:
            return level
        return apply_rules(level, rules).filter("allowed").drop("allowed")

    start = _seed_frame(spark, seeds).select(
        "url",
        F.lit(0).alias("depth"),
        F.lit(None).cast("string").alias("referer"),
        F.lit(1).cast("bigint").alias("visits"),
    )
    level = permitted(start).checkpoint()
    visited = level
    seen = level.count()
    depth = 0
    while (max_depth is None or depth < max_depth) and (max_pages is None or seen < max_pages):
        depth += 1
        sources = (
            level.groupBy(F.col("url").alias("src_url"))
            .agg(F.sum("visits").alias("visits"))
            .withColumn("salt", every_salt)
        )
        reached = sources.hint("merge").join(edges, ["src_url", "salt"]).select(
            F.col("dst_url").alias("url"), F.col("src_url").alias("referer"), "visits"
        )
        if dedupe:
            candidates = reached.groupBy("url").agg(
                F.min("referer").alias("referer"), F.lit(1).cast("bigint").alias("visits")
            )
        else:
            candidates = reached.groupBy("url", "referer").agg(F.sum("visits").alias("visits"))
        fresh = candidates.join(visited.select("url").hint("merge"), "url", "left_anti")
        level = (
            permitted(fresh)
            .select("url", F.lit(depth).alias("depth"), "referer", "visits")
            .checkpoint()
        )
        found = level.agg(F.sum("visits")).first()[0] or 0
        if not found:
            break
        seen += found
        visited = visited.unionByName(level)
    ordered = numbered(visited, ["depth", "url", "referer"])
    spark.sql(f"DROP TABLE {name}")
    return ordered if max_pages is None else page_budget(ordered, max_pages)


def _bucketed(edges: DataFrame, partitions: int) -> str:
    """Write the edges as a table of so many buckets by source and salt; its name in the session's catalog.

    Its files lie in the shared folder and stay there when the name is dropped.
    """
    spark = edges.sparkSession
    path = scratch_path(spark, "edges")
    name = "edges_" + path.rsplit("-", 1)[1]
    dealt = edges.repartition(partitions, "src_url", "salt")
    dealt.write.bucketBy(partitions, "src_url", "salt").sortBy("src_url").option("path", path).saveAsTable(name)
    return name


def page_budget(frontier: DataFrame, max_pages: int) -> DataFrame:
    """The first ``max_pages`` pages in breadth-first order, inside a level by url.

    Takes a frontier with or without its ``order``; nothing is gathered in one task.
    """
    if "order" in frontier.columns:
        return frontier.filter(F.col("order") < max_pages)
    return numbered(frontier, ["depth", "url"]).filter(F.col("order") < max_pages).drop("order")
