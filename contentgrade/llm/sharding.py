"""Contiguous shards of nearly equal byte size by global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentgrade.llm.common import checkpointed, quoted

# By what part of a shard a cut may move to keep the rows of a group in one shard.
GROUP_SLACK = 0.02


def _with_starts(ranged: DataFrame, offsets: DataFrame, bounds: Sequence[int] | None = None) -> DataFrame:
    """Running sums inside each sorted partition, on top of the sums of those before it.

    Adds ``_start`` (bytes before the row) and ``_index`` (rows before it) or, given the row
    indexes where shards begin, ``shard`` and ``slot``. Rows pass in batches; a batch needs
    two numbers from the one before.
    """
    from pyspark.sql import types as T

    names = ("_start", "_index") if bounds is None else ("shard", "slot")
    placed = ranged.join(F.broadcast(offsets), "_part")
    fields = [f for f in placed.schema.fields if f.name not in ("_part", "_bytes_before", "_rows_before")]
    kinds = (T.LongType(), T.LongType()) if bounds is None else (T.IntegerType(), T.LongType())
    schema = T.StructType([*fields, *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]])
    firsts = None if bounds is None else np.array([0, *bounds], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_before = row_before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if size_before is None:
                size_before = batch.column("_bytes_before")[0].as_py()
                row_before = batch.column("_rows_before")[0].as_py()
            sizes = batch.column("_size").to_numpy(zero_copy_only=False).astype(np.int64)
            index = row_before + np.arange(len(sizes), dtype=np.int64)
            if firsts is None:
                added = [pa.array(size_before + np.cumsum(sizes) - sizes), pa.array(index)]
            else:
                shard = np.searchsorted(firsts, index, side="right") - 1
                added = [pa.array(shard.astype(np.int32)), pa.array(index - firsts[shard])]
            size_before += int(sizes.sum())
            row_before += len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in fields] + added, names=[f.name for f in fields] + list(names)
            )

    return placed.mapInArrow(run, schema)


def _bounds(rows: DataFrame, total: int, shards: int) -> list[int]:
    """The row index at which each shard but the first begins.

    A cut is where the running sum passes a multiple of the target; it goes to the nearer
    side of its row, or to the nearer end of the row's group if that is no further away than
    ``GROUP_SLACK`` of a shard. At most one row and one group per cut are looked at.
    """
    end = F.col("_start") + F.col("_size")
    first = F.floor(F.col("_start") * F.lit(shards) / F.lit(float(total)))
    last = F.floor((end - 1) * F.lit(shards) / F.lit(float(total)))
    near = rows.filter((first != last) | (F.col("_start") * shards % total == 0)).select("_group", "_start", "_size", "_index")
    found = sorted(near.collect(), key=lambda r: r["_start"])
    spans = {
        r["_group"]: r
        for r in rows.filter(F.col("_group").isin([r["_group"] for r in found]))
        .groupBy("_group")
        .agg(
            F.min("_start").alias("start"),
            F.max(end).alias("end"),
            F.min("_index").alias("first"),
            (F.max("_index") + 1).alias("next"),
        )
        .collect()
    }
    out: list[int] = []
    for k in range(1, shards):
        target = k * total / shards
        row = next((r for r in found if r["_start"] < target <= r["_start"] + r["_size"]), None)
        if row is None:
            row = min(found, key=lambda r: abs(r["_start"] - target))
        sides = [(row["_start"], row["_index"]), (row["_start"] + row["_size"], row["_index"] + 1)]
        span = spans[row["_group"]]
        ends = [(span["start"], span["first"]), (span["end"], span["next"])]
        nearest = min(ends, key=lambda s: abs(s[0] - target))
        if abs(nearest[0] - target) > GROUP_SLACK * total / shards:
            nearest = min(sides, key=lambda s: abs(s[0] - target))
        out.append(max(nearest[1], out[-1] if out else 0))
    return out


def shard_by_bytes(rows: DataFrame, size: Column, group: Column, order: Sequence[str], shards: int = 16) -> DataFrame:
    """Number the rows by shard so that the shards are contiguous and nearly equal in bytes.

    Rows are range-partitioned and sorted by a 64-bit hash of ``group``, the columns of
    ``order`` and their place in the input, so that rows of one group are neighbours and
    even a group or row that makes up a third of the table spreads over many partitions.
    The sums of the partitions, one row each, give every partition its start, and the rows
    inside run on from there. Cuts lie at equal parts of all bytes.

    Adds ``shard`` and ``slot`` (place in the shard, from 0 without gaps), which replace
    columns of those names. Sizes must be at least 1; a null size counts as 1. A null group
    is a group. An empty table gives an empty table. What reaches the driver is a row per cut.
    """
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    packed = rows.select(
        F.struct(*[F.col(quoted(c)) for c in kept]).alias("_row"),
        F.coalesce(size.cast("bigint"), F.lit(1)).alias("_size"),
        F.xxhash64(group).alias("_group"),
        F.struct(*[F.col(quoted(c)) for c in order], F.monotonically_increasing_id()).alias("_order"),
    )
    ranged = checkpointed(packed.repartitionByRange("_group", "_order").sortWithinPartitions("_group", "_order").drop("_order"))
    ranged = ranged.withColumn("_part", F.spark_partition_id())
    sums = ranged.groupBy("_part").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = checkpointed(
        sums.select(
            "_part",
            F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
            (F.col("_bytes")).alias("_own"),
        )
    )
    total = offsets.agg(F.sum("_own")).first()[0] or 0
    offsets = offsets.drop("_own")
    bounds = _bounds(_with_starts(ranged.drop("_row"), offsets), total, shards) if total else []
    return _with_starts(ranged, offsets, bounds).select("_row.*", "shard", "slot")
