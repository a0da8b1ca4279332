"""robots.txt bodies to rule groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentgrade.functions.text import strip
from contentgrade.functions.urls import percent_decoded
from contentgrade.operators.barrier import sealed


_EVENT = "struct<pos:int,kind:string,key:string,value:string>"


def _event(raw: Column, pos: Column) -> Column:
    """A line of a file as ``pos, kind, key, value``; lines that mean nothing have no kind."""
    text = F.regexp_replace(raw, "(?s)#.*", "")
    key = F.lower(strip(F.regexp_extract(text, r"(?s)\A([^:]*):", 1)))
    value = strip(F.regexp_extract(text, r"(?s)\A[^:]*:(.*)", 1))
    kind = (
        F.when(raw == "", F.lit("blank"))
        .when(key == "user-agent", F.lit("agent"))
        .when(key.isin("allow", "disallow", "crawl-delay", "request-rate"), F.lit("rule"))
        .when(key == "sitemap", F.lit("sitemap"))
    )
    return F.struct(
        pos.alias("pos"), kind.alias("kind"), key.alias("key"), percent_decoded(value).alias("value")
    ).cast(_EVENT)


def _group(lines: Column) -> Column:
    """The lines of one group as ``agents, crawl_delay, rules, n_rules``."""
    of_rules = F.filter(lines, lambda line: line["kind"] == "rule")
    paths = F.filter(of_rules, lambda line: line["key"].isin("allow", "disallow"))
    delays = F.filter(
        of_rules, lambda line: (line["key"] == "crawl-delay") & line["value"].rlike(r"\A[0-9]+\z")
    )
    return F.struct(
        F.transform(F.filter(lines, lambda line: line["kind"] == "agent"), lambda line: line["value"]).alias("agents"),
        F.try_element_at(delays, F.lit(-1))["value"].cast("double").alias("crawl_delay"),
        F.transform(
            paths,
            lambda line: F.struct(
                line["pos"].alias("seq"),
                # An empty Disallow allows everything.
                ((line["key"] == "allow") | (line["value"] == "")).alias("allow"),
                line["value"].alias("path"),
            ),
        ).alias("rules"),
        F.size(of_rules).alias("n_rules"),
    )


def robots_files(robots: DataFrame) -> DataFrame:
    """Parse ``host, status_code, body`` to one row per file: ``host, groups, sitemaps``.

    A file is read within its row, by a pass over its lines: neither a shuffle nor a window.
    A user-agent line opens a group unless it directly follows another one. A blank line ends
    the group; rules after it have no agent and do not count. ``groups`` has the groups with
    rules as ``group_no, agents, crawl_delay, rules``, with ``rules`` as ``seq, allow, path``
    in file order. Files with an error status or a blank body are left out, so everything on
    such a host is allowed.
    """
    usable = robots.filter((F.col("status_code") < 400) & (strip(F.col("body")) != ""))
    lines = F.transform(F.split("body", r"\r\n|\r|\n"), _event)
    events = usable.select("host", F.filter(lines, lambda line: line["kind"].isNotNull()).alias("_events"))
    # Sitemaps stand outside of groups and part none.
    parted = sealed(events).select(
        "host",
        F.filter("_events", lambda line: line["kind"] != "sitemap").alias("_lines"),
        F.transform(
            F.filter("_events", lambda line: line["kind"] == "sitemap"), lambda line: line["value"]
        ).alias("sitemaps"),
    )
    # A group reaches from the line that opens it to the next such line or blank.
    place = F.sequence(F.lit(1), F.greatest(F.size("_lines"), F.lit(1)))

    def cuts(at: Column) -> Column:
        kind = F.get(F.col("_lines"), at - 1)["kind"]
        follows = F.coalesce(F.get(F.col("_lines"), at - 2)["kind"] == "agent", F.lit(False))
        return (kind == "blank") | ((kind == "agent") & ~follows)

    cut = sealed(parted).withColumn("_cuts", F.filter(place, cuts))
    pieces = F.transform(
        "_cuts",
        lambda start, i: F.slice(
            F.col("_lines"), start, F.coalesce(F.get(F.col("_cuts"), i + 1), F.size("_lines") + 1) - start
        ),
    )
    opened = sealed(cut).select("host", "sitemaps", F.filter(pieces, lambda p: p[0]["kind"] == "agent").alias("_pieces"))
    read = sealed(opened).select("host", "sitemaps", F.transform("_pieces", _group).alias("_groups"))
    groups = F.transform(
        "_groups",
        lambda group, i: F.struct(
            (i + 1).alias("group_no"),
            group["agents"].alias("agents"),
            group["crawl_delay"].alias("crawl_delay"),
            group["rules"].alias("rules"),
            group["n_rules"].alias("n_rules"),
        ),
    )
    with_rules = F.filter(groups, lambda group: group["n_rules"] > 0)
    return sealed(read).select(
        "host",
        F.transform(
            with_rules,
            lambda group: F.struct(*[group[name].alias(name) for name in ("group_no", "agents", "crawl_delay", "rules")]),
        ).alias("groups"),
        "sitemaps",
    )


def latest_robots(fetches: DataFrame, at: str = "fetched_at") -> DataFrame:
    """The latest file of each host from ``host, status_code, body`` and a time.

    Of equal times the larger status and then the larger body counts. Partial aggregation
    leaves one body per host and partition to move.
    """
    last = F.max_by(F.struct("status_code", "body"), F.struct(at, "status_code", "body"))
    return fetches.groupBy("host").agg(last.alias("_last")).select("host", "_last.*")


def parse_robots(robots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parse ``host, status_code, body``, one row per host, into groups and sitemaps.

    The first result has one row per group with rules: ``host, group_no, agents,
    crawl_delay, rules``, where ``rules`` is an array of ``seq, allow, path`` in file order.
    The second lists ``host, sitemaps``. A host with an error status or a blank body appears
    in neither, so everything on it is allowed. For several fetches of a host see
    :func:`latest_robots`.
    """
    files = robots_files(robots)
    groups = files.select("host", F.inline("groups"))
    return groups, files.filter(F.size("sitemaps") > 0).select("host", "sitemaps")


def robots_rules(groups: DataFrame) -> DataFrame:
    """The rules of all groups one per row: ``host, group_no, agents, seq, allow, path``."""
    return groups.select("host", "group_no", "agents", F.inline("rules"))


def _applies(agents: Column, agent: str) -> Column:
    """True if one of a group's agent names occurs in the product part of ``agent``."""
    product = agent.split("/")[0].lower()
    return F.exists(agents, lambda name: (name == "*") | F.contains(F.lit(product), F.lower(name)))


def agent_rules(groups: DataFrame, agent: str) -> DataFrame:
    """What one agent has to obey, one row per host: ``host, rules, crawl_delay``.

    The first group that names the agent decides, else the first group for ``*``. Only the
    crawl delay of a group without one falls back to ``*``. ``groups`` are those of
    :func:`parse_robots`, or the files of :func:`robots_files`, which need no shuffle.
    """

    def is_default(agents: Column) -> Column:
        return F.array_contains(agents, F.lit("*"))

    def is_own(agents: Column) -> Column:
        return ~is_default(agents) & _applies(agents, agent)

    if "groups" in groups.columns:

        def first(named) -> Column:
            return F.get(F.filter("groups", lambda group: named(group["agents"])), 0)

        chosen = sealed(groups.select("host", first(is_own).alias("own"), first(is_default).alias("default")))
        chosen = chosen.filter(F.col("own").isNotNull() | F.col("default").isNotNull())
    else:
        choice = F.struct("group_no", "rules", "crawl_delay")

        def first(named) -> Column:
            return F.min_by(choice, F.when(named(F.col("agents")), F.col("group_no")))

        chosen = groups.filter(is_own(F.col("agents")) | is_default(F.col("agents"))).groupBy("host").agg(
            first(is_own).alias("own"), first(is_default).alias("default")
        )
    return chosen.select(
        "host",
        F.when(F.col("own").isNotNull(), F.col("own.rules"))
        .otherwise(F.col("default.rules"))
        .alias("rules"),
        F.coalesce(
            F.nullif("own.crawl_delay", F.lit(0.0)), F.nullif("default.crawl_delay", F.lit(0.0))
        ).alias("crawl_delay"),
    )
