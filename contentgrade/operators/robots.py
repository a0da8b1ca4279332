"""robots.txt rules applied to urls."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentgrade.functions import urls as U
from contentgrade.operators.skew import lookup
from contentgrade.session import importable_by_workers
from contentgrade.sources.robots import agent_rules

_CHAIN = pa.struct([("length", pa.int32()), ("allow", pa.bool_())])
_INDEX = pa.list_(pa.struct([("path", pa.string()), ("chain", pa.list_(_CHAIN))]))


def _indexed(rules: list[dict]) -> list[dict]:
    """The paths of rules in order; each with all paths that begin it and what is decided there.

    Of rules of which one begins the other the first in the file decides.
    """
    first: dict[str, tuple[int, bool]] = {}
    for rule in sorted(rules, key=lambda r: r["seq"]):
        path = "" if rule["path"] == "*" else rule["path"]
        first.setdefault(path, (rule["seq"], rule["allow"]))
    out, around = [], []
    for path in sorted(first):
        while around and not path.startswith(around[-1][0]):
            around.pop()
        decides = min(first[path], around[-1][1]) if around else first[path]
        around.append((path, decides))
        out.append({"path": path, "chain": [{"length": len(p), "allow": allow} for p, (_, allow) in around]})
    return out


def index_rules(rules: DataFrame) -> DataFrame:
    """``host, rules`` with the rules of ``agent_rules`` as an index of path prefixes."""
    importable_by_workers(rules.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = [_indexed(of_host or []) for of_host in batch["rules"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["host"], pa.array(index, _INDEX)], names=["host", "rules"])

    found = "host string, rules array<struct<path: string, chain: array<struct<length: int, allow: boolean>>>>"
    return rules.select("host", "rules").mapInArrow(build, found)


def _decision(index: Column, path: Column) -> Column:
    """What the rules say of a path, null if none is a prefix of it.

    A search by halves finds the last rule that isn't behind the path in order. Every rule
    that is a prefix of the path begins that one too, so its chain holds them all.
    """
    size = F.size(index)
    halves = F.sequence(F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))

    def step(at: Column, half: Column) -> Column:
        to = at + F.pow(F.lit(2), half).cast("int")
        return F.when((to <= size) & (F.get(index, to - 1)["path"] <= path), to).otherwise(at)

    last = F.get(index, F.aggregate(halves, F.lit(0), step) - 1)
    prefixes = F.filter(
        last["chain"],
        lambda link: F.substring(last["path"], F.lit(1), link["length"]) == F.substring(path, F.lit(1), link["length"]),
    )
    return F.try_element_at(prefixes, F.lit(-1))["allow"]


def robots_allowed(
    urls: DataFrame, groups: DataFrame, agent: str, url: str = "url", salts: int = 16
) -> DataFrame:
    """Add ``allowed`` for one agent, from ``robots_files`` or the groups of ``parse_robots``."""
    return apply_rules(urls, index_rules(agent_rules(groups, agent)), url, salts)


def apply_rules(urls: DataFrame, rules: DataFrame, url: str = "url", salts: int = 16) -> DataFrame:
    """Add ``allowed``: the first rule in file order whose path is a prefix decides.

    ``rules`` come from ``index_rules``. The index of a host travels as one array, so a url
    meets it in its own row: nothing is multiplied by the number of rules, and a url looks at
    as many of them as their number has binary digits. A hot host is no problem, since the table
    of rules is either broadcast or, if it is large, met by a salted join.
    """
    table = rules.select(F.col("host").alias("_host"), "rules")
    keyed = urls.withColumns(
        {"_host": U.netloc(F.col(url)), "_path": U.robots_path(F.col(url))}
    )
    joined = lookup(keyed, table, "_host", salts, F.col(url))
    decision = _decision(F.col("rules"), F.col("_path"))
    return joined.withColumn("allowed", F.coalesce(decision, F.lit(True))).drop("_host", "_path", "rules")


def effective_delay(
    hosts: DataFrame, groups: DataFrame, agent: str, default_delay: float
) -> DataFrame:
    """Add ``delay``: the longer of the default and what the host asks for."""
    delays = agent_rules(groups, agent).select("host", "crawl_delay")
    return hosts.join(delays, "host", "left").withColumn(
        "delay",
        F.greatest(F.lit(float(default_delay)), F.coalesce("crawl_delay", F.lit(0.0))),
    )
