"""Retry policy and response cache over logs of what happened."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contentgrade.session import shared_dir

# The retry policy.
MAX_ATTEMPTS = 3
FIRST_WAIT_SECONDS = 1.0

RETRIED = ("timeout", "connection", "request")


def number_attempts(
    log: DataFrame, at: str, tiebreak: str, url: str = "url", max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """Number the attempts per url in time order and keep those the policy would make.

    The filter on the row number lets Spark cut every group to ``max_attempts`` rows before
    the shuffle, so a url with millions of attempts stays small.
    """
    in_order = Window.partitionBy(url).orderBy(at, tiebreak)
    return log.withColumn("attempt", F.row_number().over(in_order)).filter(
        F.col("attempt") <= max_attempts
    )


def final_attempts(
    attempts: DataFrame, url: str = "url", max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """The outcome per url that the policy would report, with the seconds waited before it.

    Success and HTTP errors end the attempts, timeouts and other failures go on. Both
    candidates are aggregates, which Spark combines before the shuffle.
    """
    considered = attempts.filter(F.col("attempt") <= max_attempts)
    carried = [c for c in attempts.columns if c != url]
    row = F.struct(*carried)
    ends = ~F.col("outcome").isin(*RETRIED)
    chosen = considered.groupBy(url).agg(
        F.min_by(row, F.when(ends, F.col("attempt"))).alias("ended"),
        F.max_by(row, "attempt").alias("last"),
    )
    picked = chosen.select(url, F.coalesce("ended", "last").alias("final")).select(url, "final.*")
    waited = F.lit(FIRST_WAIT_SECONDS) * (F.pow(F.lit(2.0), F.col("attempt") - 1) - 1.0)
    return picked.withColumn("waited_seconds", waited)


def cached_fetch(
    requests: DataFrame,
    fetches: DataFrame,
    ttl_seconds: int = 3600,
    url: str = "url",
    requested_at: str = "requested_at",
    fetched_at: str = "fetched_at",
    payload: Sequence[str] = (),
) -> DataFrame:
    """Add ``cached_at``: the latest fetch of the url at most ``ttl_seconds`` old, or null.

    An as-of lookup without pairs, as a scan over segments. Requests and fetches together are dealt
    to partitions by ranges of url and time, so that a url of any share of the rows fills as many
    partitions as it needs, even if all its rows are of one hour or one instant. Each
    partition is scanned by itself. What it has to know from those before it is one fetch at most, the last
    of the url that it begins with; a second pass over one row per partition finds that.

    A fetch at the very time of a request counts. Requests without a url or a time stay, with
    a null. Columns named in ``payload`` are taken from the fetch that was found, as
    ``cached_<name>``; of several at one time it is the one of the greatest hash of these.
    """
    ttl = ttl_seconds * 1_000_000
    shared_dir(requests.sparkSession)
    at = F.unix_micros(F.col(fetched_at).cast("timestamp"))
    seen = fetches.filter(F.col(url).isNotNull() & F.col(fetched_at).isNotNull()).select(
        F.col(url).alias("_url"),
        at.alias("_at"),
        F.lit(1).alias("_kind"),
        (F.xxhash64(F.to_json(F.struct(*payload))) if payload else F.lit(0).cast("bigint")).alias("_spread"),
        F.struct(at.alias("at"), *payload).alias("_found"),
    )
    request = F.struct(*[F.col(name) for name in requests.columns])
    asked_at = F.unix_micros(F.col(requested_at).cast("timestamp"))
    keyed = F.col(url).isNotNull() & asked_at.isNotNull()
    asked = requests.filter(keyed).select(
        F.col(url).alias("_url"),
        asked_at.alias("_at"),
        F.lit(2).alias("_kind"),
        F.xxhash64(F.to_json(request)).alias("_spread"),
        request.alias("_request"),
    )
    order = ["_at", "_kind", "_spread"]
    rows = asked.unionByName(seen, allowMissingColumns=True)
    # A checkpoint keeps partitions as they are, so both passes see the same ones.
    dealt = rows.repartitionByRange("_url", *order).checkpoint().withColumn("_part", F.spark_partition_id())
    scan = Window.partitionBy("_part", "_url").orderBy(*order)
    answered = (
        dealt.unionByName(_carried(dealt), allowMissingColumns=True)
        .withColumn("_last", F.last("_found", ignorenulls=True).over(scan.rowsBetween(Window.unboundedPreceding, 0)))
        .filter(F.col("_kind") == 2)
        .withColumn("_fresh", F.when(F.col("_last.at") >= F.col("_at") - ttl, F.col("_last")))
    )
    hit = answered.select(
        "_request.*",
        F.timestamp_micros("_fresh.at").alias("cached_at"),
        *[F.col(f"_fresh.{name}").alias(f"cached_{name}") for name in payload],
    )
    return hit.unionByName(requests.filter(~keyed), allowMissingColumns=True)


def _carried(dealt: DataFrame) -> DataFrame:
    """For each partition the last earlier fetch of the url it begins with, as a row before all others.

    A url that goes on in the next partition is the last of its own, so one row per
    partition, with its first url and its last fetch, tells everything.
    """
    is_fetch = F.col("_kind") == 1
    ends = dealt.groupBy("_part").agg(
        F.min("_url").alias("first"),
        F.max_by(F.struct("_url", "_found"), F.when(is_fetch, F.struct("_url", "_at", "_spread"))).alias("last"),
    )
    heads = ends.select("_part", F.col("first").alias("_url"), F.lit(0).alias("place"))
    tails = ends.filter("last is not null").select("_part", "last.*", F.lit(1).alias("place"))
    along = Window.partitionBy("_url").orderBy("_part", "place").rowsBetween(Window.unboundedPreceding, 0)
    known = heads.unionByName(tails, allowMissingColumns=True).withColumn("_found", F.last("_found", ignorenulls=True).over(along))
    found = known.filter((F.col("place") == 0) & F.col("_found").isNotNull())
    return found.select("_part", "_url", F.col("_found.at").alias("_at"), F.lit(0).alias("_kind"), "_found")
