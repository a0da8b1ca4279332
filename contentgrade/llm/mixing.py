"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentgrade.llm.common import checkpointed, columns_of, quoted, small_or_salted

HASH_BITS = 60
DIGIT_BITS = 12
# A document of more than one part in so many of its source is picked before the others.
LARGE_PART = 20


def seeded_hash(key: Column, seed: str) -> Column:
    """60 pseudo-random bits of a key as a number, the same in every run and engine."""
    text = F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def weigh_sources(rows: DataFrame, pattern: Sequence[int]) -> DataFrame:
    """One row per source with its size and its weight by rank, null last.

    Ranks come from a range partitioning and counts per partition, so no task sees all sources.
    """
    totals = rows.groupBy("_key", "_source").agg(F.sum("_size").alias("_total"))
    ranged = checkpointed(
        totals.repartitionByRange(F.col("_source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    )
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn(
        "_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    )
    inside = Window.partitionBy("_part").orderBy(F.col("_source").asc_nulls_last())
    place = F.row_number().over(inside) - 1 + F.col("_before")
    weights = F.array(*[F.lit(int(w)) for w in pattern])
    weight = F.element_at(weights, (F.pmod(place, F.lit(len(pattern))) + 1).cast("int"))
    return checkpointed(
        ranged.join(F.broadcast(before.drop("_n")), "_part").select("_key", "_total", weight.alias("_weight"))
    )


def water_level(sources: DataFrame, amount: float, max_epochs: int) -> float:
    """The words per unit of weight at which the targets add up to ``amount``.

    Sources above ``max_epochs`` times their size are clamped and what they leave is shared
    by weight, until none is above. A round is one aggregation over the sources; the level
    never falls, so the rounds end.
    """
    cap = F.col("_total") * max_epochs
    level, clamped = 0.0, -1
    while True:
        over = F.col("_weight") * F.lit(level) > cap
        n, full, weight = sources.agg(
            F.coalesce(F.sum(over.cast("int")), F.lit(0)),
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("_weight"))), F.lit(0)),
        ).first()
        if n == clamped or not weight:
            return level if weight else float("inf")
        level, clamped = (amount - full) / weight, n


def _cut_large(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source, up to which hash its few large documents get one more repetition."""
    inside = Window.partitionBy("_key").orderBy("_u")
    summed = (
        rows.filter("_large")
        .groupBy("_key", "_u", "_fraction")
        .agg(F.sum("_size").alias("_s"))
        .withColumn("_cum", F.sum("_s").over(inside))
        .withColumn("_want", F.col("_fraction") * F.sum("_s").over(Window.partitionBy("_key")))
        .filter(2 * F.col("_cum") - F.col("_s") <= 2 * F.col("_want"))
        .groupBy("_key")
        .agg((F.max("_u") + 1).alias("_cut_large"), F.sum("_s").alias("_taken_large"))
    )
    return checkpointed(
        sources.join(summed, "_key", "left").select(
            *sources.columns,
            F.coalesce("_cut_large", F.lit(0)).alias("_cut_large"),
            (F.col("_extra") - F.coalesce("_taken_large", F.lit(0))).alias("_want"),
        )
    )


def _cut_small(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source, up to which hash its other documents get one more repetition.

    The hash is found digit by digit: a round adds up sizes by the next digit inside the one
    prefix that holds the cut, 4096 sums per source at most, until one hash is left there.
    """
    top = 1 << HASH_BITS
    edges = checkpointed(
        sources.select("_key", "_want", F.lit(0).cast("bigint").alias("_base"), F.lit(0).cast("bigint").alias("_below"))
    )
    for shift in range(HASH_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        digit = F.shiftright("_u", shift)
        inside = F.shiftright("_u", shift + DIGIT_BITS) == F.shiftright("_base", shift + DIGIT_BITS)
        sums = (
            small_or_salted(rows.filter("not _large"), edges, "_key")
            .filter(inside & (F.col("_base") < top))
            .groupBy("_key", digit.alias("_digit"))
            .agg(F.sum("_size").alias("_s"), F.min("_u").alias("_u0"), F.max("_u").alias("_u1"))
        )
        running = F.sum("_s").over(Window.partitionBy("_key").orderBy("_digit"))
        found = (
            sums.join(edges, "_key")
            .withColumn("_cum", running + F.col("_below"))
            .filter("_cum > _want")
            .groupBy("_key")
            .agg(F.min(F.struct("_digit", "_cum", "_s", "_u0", "_u1")).alias("_at"))
        )
        edges = checkpointed(
            edges.join(found, "_key", "left").select(
                "_key",
                "_want",
                F.when(F.col("_at").isNull(), F.lit(top)).otherwise(F.col("_at._u0")).alias("_base"),
                F.coalesce(F.col("_at._cum") - F.col("_at._s"), F.lit(0)).alias("_below"),
                F.coalesce("_at._s", F.lit(0)).alias("_s"),
                F.coalesce(F.col("_at._u1") > F.col("_at._u0"), F.lit(False)).alias("_open"),
            )
        )
        if not edges.agg(F.max("_open")).first()[0]:
            break
        edges = edges.drop("_s", "_open")
    whole = (2 * F.col("_below") + F.col("_s") <= 2 * F.col("_want")).cast("bigint")
    return edges.select("_key", F.when(F.col("_base") >= top, F.lit(top)).otherwise(F.col("_base") + whole).alias("_cut"))


def mix_sources(
    docs: DataFrame,
    size: Column,
    key: Column,
    source: str = "source",
    pattern: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: str = "mix:",
) -> DataFrame:
    """How often each document is taken so that the sources meet their targets.

    Sources in code point order, null last, weigh ``pattern``, repeating, and share ``share``
    times the size of all documents; no target is above ``max_epochs`` times its source's
    size. A document is taken as often as its source's target goes into whole repetitions,
    and once more if its seeded hash is below the source's cut, which is set so that the
    sizes add up to the target. The few documents of a source that hold more than a
    twentieth of it are decided first, and the others make up for the difference.

    Adds ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_times``, which replace
    columns of those names; all others stay. Sizes must not be negative. A null size counts
    as 0, the documents of a source without words are taken once, a null source is a source, rows
    of equal keys are taken alike, an empty table gives
    an empty table. Nothing but sums over sources reaches the driver.
    """
    kept = [c for c in docs.columns if c not in ("mix_size", "mix_source_size", "mix_target", "mix_times")]
    rows = docs.select(
        F.struct(*[F.col(quoted(c)) for c in kept]).alias("_row"),
        F.col(source).alias("_source"),
        _source_key(F.col(source)).alias("_key"),
        F.coalesce(size.cast("bigint"), F.lit(0)).alias("_size"),
        seeded_hash(key, seed).alias("_u"),
    )
    sources = weigh_sources(rows.select("_key", "_source", "_size"), pattern)
    amount = share * (sources.agg(F.sum("_total")).first()[0] or 0)
    level = water_level(sources, amount, max_epochs)
    cap = F.col("_total") * max_epochs
    filled = F.least(cap.cast("double"), F.col("_weight") * F.lit(level)) if level != float("inf") else cap.cast("double")
    sources = sources.withColumn("_target", filled).withColumn(
        "_whole", F.when(F.col("_total") > 0, F.floor(F.col("_target") / F.col("_total"))).otherwise(F.lit(0))
    )
    sources = sources.withColumn("_extra", F.col("_target") - F.col("_whole") * F.col("_total")).withColumn(
        "_fraction", F.when(F.col("_total") > 0, F.col("_extra") / F.col("_total")).otherwise(F.lit(0.0))
    )
    sources = checkpointed(sources)
    large = F.col("_size") * LARGE_PART > F.col("_total")
    narrow = checkpointed(
        small_or_salted(rows.select("_key", "_size", "_u"), sources.select("_key", "_total", "_fraction"), "_key").select(
            "_key", "_size", "_u", "_fraction", large.alias("_large")
        )
    )
    sources = _cut_large(narrow, sources)
    cuts = _cut_small(narrow.drop("_fraction"), sources)
    params = checkpointed(
        sources.join(cuts, "_key").select("_key", "_total", "_target", "_whole", "_cut_large", "_cut")
    )
    once_more = F.col("_u") < F.when(large, F.col("_cut_large")).otherwise(F.col("_cut"))
    return small_or_salted(rows, params, "_key").select(
        "_row.*",
        F.col("_size").alias("mix_size"),
        F.col("_total").alias("mix_source_size"),
        F.col("_target").alias("mix_target"),
        (F.col("_whole") + once_more.cast("bigint")).alias("mix_times"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, one row per repetition, with the columns they came with."""
    times = mix_sources(docs, **options)
    copies = times.filter("mix_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("mix_times"))))
    return copies.select(*columns_of(docs))
