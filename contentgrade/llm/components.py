"""Connected components of a graph of 64-bit ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentgrade.llm.common import checkpointed


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each vertex with the smallest id of its component: columns ``uid`` and ``label``.

    Alternates two steps until nothing changes: every vertex ties its larger neighbours to the
    smallest id it sees, then itself and its smaller ones. Each step is a minimum per vertex,
    combined before the shuffle, and a join that adaptive execution splits for vertices of
    many links. The edges stay tables; the driver sees a count and a checksum per round.
    A vertex that has no link, or only one to itself, isn't in the result.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    edges = checkpointed(edges)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = edges.filter("u != v").distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        edges = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        edges = checkpointed(edges.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    roots = edges.select("v").distinct()
    return checkpointed(
        edges.select(F.col("u").alias("uid"), F.col("v").alias("label")).unionByName(
            roots.select(F.col("v").alias("uid"), F.col("v").alias("label"))
        )
    )
