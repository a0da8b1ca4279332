"""Helpers for lookups and ranks on data in which one key may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentgrade.session import shared_dir


def salted_lookup(
    rows: DataFrame, lookup: DataFrame, key: str, salts: int = 16, spread_by: Column | None = None
) -> DataFrame:
    """Left join with a table of at most one row per key, with hot keys split ``salts`` ways.

    Each lookup row is copied once per salt and each row picks one, so the rows of a hot key
    end up in ``salts`` partitions. Spark still turns this into a broadcast join by itself
    when it measures that the lookup side is small. The salt comes from a hash of
    ``spread_by`` and the number of the input partition, which parts even equal rows. It is
    not random, so a task that is run again sends its rows to the same place.
    """
    spread = F.spark_partition_id().cast("bigint")
    if spread_by is not None:
        spread = spread + F.pmod(F.xxhash64(spread_by), F.lit(salts))
    salted = rows.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")


# A lookup table whose rows take no more than this as JSON text is sent to every executor.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def fits_broadcast(table: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Measure a lookup table. The job reads that table only, never the rows it is for."""
    size = table.select(F.octet_length(F.to_json(F.struct("*"))).cast("bigint").alias("size"))
    return (size.agg(F.sum("size")).first()[0] or 0) <= max_bytes


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    salts: int = 16,
    spread_by: Column | None = None,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Left join with a table of at most one row per key.

    A table that was measured to be small is broadcast, so the rows, which may carry whole
    documents, do not move. A larger one is met by a salted join.
    """
    if fits_broadcast(table, max_bytes):
        return rows.join(F.broadcast(table), key, "left")
    return salted_lookup(rows, table, key, salts, spread_by)


def numbered(rows: DataFrame, by: Sequence[str], name: str = "order") -> DataFrame:
    """Number rows from 0 without gaps in the order of columns that are unique together.

    Rows are dealt to partitions by ranges and sorted there. A row's number is its place in
    its partition plus the rows of the partitions before, of which there is one count per
    partition; no task holds more than a partition.
    """
    shared_dir(rows.sparkSession)
    # A checkpoint keeps partitions and their order, so both passes see the same ones.
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).checkpoint()
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = dealt.withColumns({"_part": F.spark_partition_id(), "_place": place})
    counts = placed.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("_part")) - F.col("n")
    offsets = counts.select("_part", before.alias("_before"))
    found = placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_place"))
    return found.drop("_part", "_place", "_before")


def nth_smallest(
    rows: DataFrame, hashed: str, n: int | Callable[[int], int], digits: int = 3
) -> str | None:
    """The ``n``-th smallest value of a column of hexadecimal hashes, None if there are fewer.

    Works digit by digit: each round counts rows by the next ``digits`` digits, which gives
    at most ``16**digits`` counts whatever the size of the table, and goes on inside the one
    prefix that holds the answer until few enough hashes share it. No sort of the table, and
    three rounds reach the answer among 10**12 rows. ``n`` may depend on the number of rows,
    which the first round finds anyway.
    """
    few = 16**digits
    prefix = ""
    left = None if callable(n) else n
    while True:
        inside = rows.filter(F.startswith(F.col(hashed), F.lit(prefix)))
        counts = (
            inside.groupBy(F.substring(hashed, 1, len(prefix) + digits).alias("prefix"))
            .agg(F.count("*").alias("n"))
            .orderBy("prefix")
            .collect()
        )
        if left is None:
            left = n(sum(row["n"] for row in counts))
        for row in counts:
            if left <= row["n"]:
                break
            left -= row["n"]
        else:
            return None
        if row["prefix"] == prefix:
            return prefix
        prefix = row["prefix"]
        if row["n"] <= few:
            found = rows.filter(F.startswith(F.col(hashed), F.lit(prefix))).select(hashed)
            return sorted(value for (value,) in found.collect())[left - 1]
