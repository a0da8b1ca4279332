"""Similarity join of shingle sets, size-aware: subsets of small sets, inverted lists of large ones.

Two sets with enough in common share the rarest of their elements. A small set is listed
under every pair of its rare elements, so small sets that share a pair meet. That many pairs
would be too many for a large set, which meets all sets in the inverted lists of its rare
elements instead. Where small ends is chosen by adding up both costs by size. Where many sets
are left at one key, these meet at their differences to one of them, which are rarer.

Most sets of a corpus have no partner at all, so before that a filter looks at the ``SAMPLE``
smallest hashes of each. Similar sets share ``required`` of these but for a probability below
``MISS``; a set of which other sets hold fewer leaves. The join itself and the confirmation of links
take the full sets of the others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentgrade.llm.common import checkpointed, quoted, small_or_salted, stored
from contentgrade.llm.components import components
from contentgrade.llm.neardup import mix, shingle_set

SAMPLE = 96
MISS = 1e-10
# Rounds in which a set is compared with one other set; after them all pairs left are compared.
ROUNDS = 2
# Keys at which more sets than this are left are met through the differences to one of these,
# so often one after the other; then all pairs left at a key are compared.
WIDE = 64
LEVELS = 2
# A group that holds more than this share of all rows is met by broadcast; so fewer than
# this many groups ever are.
HOT_GROUPS = 100_000
# Sets are confirmed in blocks of about so many elements.
BLOCK_ELEMENTS = 1 << 16
# Keys that a task makes at once.
KEYS = 1 << 19

_PAIRED = np.uint64(0x5D588B656C078965)

_ROUND_MASKS = mix(np.arange(1, 64, dtype=np.uint64)).view(np.int64)


def required(similarity_percent: int, sample: int = SAMPLE, miss: float = MISS) -> int:
    """How many of their ``sample`` smallest hashes two similar large sets share, but for ``miss``.

    The smallest hashes of the union are a random sample of it, of which the similarity's share is in both
    sets, and what is in both is among the smallest of either.
    """
    p, below = similarity_percent / 100, 0.0
    for n in range(sample + 1):
        below += math.comb(sample, n) * p**n * (1 - p) ** (sample - n)
        if below > miss:
            return max(n, 1)
    return sample


def _with_sets(documents: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """doc_id, n_shingles, a hash of the set (null without words) and the representation."""
    kind = documents.schema[key].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(value.as_py(), words) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_hash(s) for s in sets], pa.int64()),
                    pa.array([s[:SAMPLE].view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "sid", "sample"],
            )

    rows = documents.select(F.col(quoted(key)).alias("doc_id"), F.col(quoted(text)).cast("string").alias("_text"))
    return rows.mapInArrow(measure, f"doc_id {kind}, n_shingles long, sid long, sample array<long>")


def set_hash(shingles: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63) if len(shingles) else None


def _with_group(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """Rows of the listed groups. ``groups`` is stored and has the number of ``rows`` in ``size``.

    A group of more than one in ``HOT_GROUPS`` of all rows is broadcast, and fewer than that
    many groups can be so large; the rows of the others are dealt by key.
    """
    hot = groups.filter(F.col("size") > total / HOT_GROUPS).withColumn("_hot", F.lit(True))
    split = rows.join(F.broadcast(hot), key, "left")
    names = [c for c in groups.columns if c != key]
    cold = split.filter("_hot is null").drop("_hot", *names)
    cold = cold.join(groups.filter(F.col("size") <= total / HOT_GROUPS), key)
    return split.filter("_hot").drop("_hot").unionByName(cold)


def _candidates(representatives: DataFrame, similarity_percent: int) -> DataFrame:
    """sid of the sets of whose smallest hashes enough are among those of other sets."""
    entries = representatives.select("sid", "n", F.explode("sample").alias("element"))
    total = representatives.agg(F.sum(F.size("sample"))).first()[0] or 0
    lists = stored(entries.groupBy("element").agg(F.count("*").alias("size")).filter("size > 1"), "jaccard-lists")
    found = _with_group(entries, lists, "element", total).groupBy("sid", "n").agg(F.countDistinct("element").alias("shared"))
    all_held = 100 * F.col("n") < (SAMPLE + 1) * similarity_percent  # so no partner is larger than the sample
    need = F.ceil(F.lit(similarity_percent) * F.col("n") / 100)
    return found.filter(F.col("shared") >= F.when(all_held, need).otherwise(F.least(need, F.lit(required(similarity_percent))))).select("sid")


def _shared(texts: DataFrame, words: int, similarity_percent: int) -> DataFrame:
    """sid, n, shared (how many elements other sets have too), held and the rarest of these, of sets with enough of them.

    ``held`` is how many sets have one of the set's elements, in the mean; most in the middle of a family.
    """

    def list_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(value.as_py(), words) for value in batch.column(1)]
            elements = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, elements], names=["sid", "n", "elements"])

    sets = texts.select("sid", "text").mapInArrow(list_all, "sid long, n long, elements array<long>")
    entries = sets.select("sid", "n", F.explode("elements").alias("element"))
    lists = stored(entries.groupBy("element").agg(F.count("*").alias("size")).filter("size > 1"), "jaccard-full-lists")
    total = lists.agg(F.sum("size")).first()[0] or 0
    found = _with_group(entries, lists, "element", total).groupBy("sid", "n")
    found = found.agg(F.sort_array(F.collect_set(F.struct("size", "element"))).alias("elements"))
    found = found.withColumn("shared", F.size("elements").cast("bigint"))
    found = found.withColumn("held", F.aggregate("elements.size", F.lit(0).cast("bigint"), lambda a, x: a + x) / F.col("n"))
    found = found.filter(100 * F.col("shared") >= similarity_percent * F.col("n"))
    rarest = F.slice("elements", 1, _rare("n", "shared", similarity_percent, 2).cast("int"))
    return stored(found.select("sid", "n", "shared", "held", rarest.alias("elements")), "jaccard-shared")


def _rare(n: str, shared: str, similarity_percent: int, subset: int) -> Column:
    """How many of a set's rarest shared elements hold ``subset`` of those it shares with any similar set.

    What no other set has is rarer still and takes its place among the rarest.
    """
    overlap = F.ceil(F.lit(similarity_percent) * F.col(n) / 100)
    return F.greatest(F.least(F.col(shared) - overlap + subset, F.col(shared)), F.lit(0)).cast("bigint")


def _costs(shared: DataFrame, similarity_percent: int) -> DataFrame:
    """By classes of sizes, named by their largest: what sets cost as small ones and as large ones.

    The unit is a row that moves. A pair of rare elements is mostly of one set alone and moves
    once. A rare element is in another set's list by its choice, so its list is scanned for
    a candidate in every round.
    """
    one, two = (_rare("n", "shared", similarity_percent, k) for k in (1, 2))
    sizes = F.when(F.col("n") < 256, F.col("n")).otherwise(F.floor(16 * F.log2("n")) + 256)
    pairs, scanned = (two * (two - 1) / 2).cast("bigint"), one * (ROUNDS + 1)
    costs = shared.select("n", sizes.alias("class"), pairs.alias("pairs"), scanned.alias("scanned"))
    return costs.groupBy("class").agg(F.max("n"), F.sum("pairs"), F.sum("scanned")).drop("class")


def boundary(costs: list[tuple[int, int, int]]) -> int:
    """The size up to which sets are small, from (size, cost as small, cost as large); -1 if none is."""
    costs = sorted(costs)
    best, least, now = -1, sum(c[2] for c in costs), sum(c[2] for c in costs)
    for n, pairs, scanned in costs:
        now += pairs - scanned
        if now < least:
            best, least = n, now
    return best


def _keys(shared: DataFrame, border: int, similarity_percent: int) -> DataFrame:
    """key, sid, n, room, large (is the set), listed (is the key an inverted list) of all sets.

    ``room`` is the most that the set can share with another one if this is the first key,
    in the order of elements, at which both meet: nothing before it, all behind it.
    """

    def list_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows = 0, []
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                sid, n, shared_, one, two, elements = row
                own, large = np.array(elements, dtype=np.int64), n > border
                keys, room, lists = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 0
                # Small sets stand in the lists too, if a large one can be similar to them.
                if large or 100 * n >= similarity_percent * (border + 1):
                    keys, room, lists = own[:one], shared_ - np.arange(one), one
                if not large:
                    a, b = np.triu_indices(two, 1)
                    rare = mix(own[:two].view(np.uint64) ^ _PAIRED)
                    keys = np.concatenate([keys, mix(rare[a] + rare[b]).view(np.int64)])
                    room = np.concatenate([room, shared_ - b + 1])
                rows.append((keys, room, sid, n, large, lists))
                held += len(keys)
                if held >= KEYS:
                    yield whole(rows)
                    held, rows = 0, []
            if held:
                yield whole(rows)

    def whole(rows: list[tuple]) -> pa.RecordBatch:
        keys, room, sid, n, large, lists = zip(*rows, strict=True)
        times = [len(k) for k in keys]
        columns = [np.concatenate(keys), *[np.repeat(x, times) for x in (sid, n)], np.concatenate(room), np.repeat(large, times)]
        columns.append(np.concatenate([np.arange(len(k)) < m for k, m in zip(keys, lists, strict=True)]))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "sid", "n", "room", "large", "listed"])

    one, two = (_rare("n", "shared", similarity_percent, k) for k in (1, 2))
    rows = shared.select("sid", "n", "shared", one, two, "elements.element")
    found = rows.mapInArrow(list_keys, "key long, sid long, n long, room long, large boolean, listed boolean")
    return stored(found, "jaccard-keys")


def _labelled(keys: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return keys.withColumn("label", F.col("sid"))
    joined = small_or_salted(keys, labels.withColumnRenamed("uid", "sid"), "sid")
    return joined.withColumn("label", F.coalesce("label", "sid"))


def _can_be_similar(similarity_percent: int, n: str, room: str, m: str, room_m: str) -> Column:
    """Whether the sizes, and the most that each can share with others, allow for a link."""
    sizes = 100 * F.least(n, m) >= similarity_percent * F.greatest(n, m)
    return sizes & ((100 + similarity_percent) * F.least(room, room_m) >= similarity_percent * (F.col(n) + F.col(m)))


def _mixed(rows: DataFrame, mask: int, total: int, similarity_percent: int) -> tuple[DataFrame, int]:
    """Rows of the keys at which sets of several components meet, with the key's pivot, and how many they are.

    Sets without room for a link with the smallest set of the key that has room leave it.
    """
    turned = F.col("sid").bitwiseXOR(F.lit(mask))
    as_smaller = (100 + similarity_percent) * F.col("room") >= 2 * similarity_percent * F.col("n")
    groups = rows.groupBy("key").agg(
        F.count("*").alias("size"),
        F.min("label").alias("low"),
        F.max("label").alias("high"),
        F.max(F.when(F.col("large"), turned)).alias("large_pivot"),
        F.max(turned).alias("any_pivot"),
        F.max("listed").alias("list"),
        F.min(F.when(as_smaller, F.col("n"))).alias("least"),
    )
    groups = groups.filter("low < high and least is not null and (large_pivot is not null or not list)")
    groups = groups.withColumn("pivot", F.coalesce("large_pivot", "any_pivot").bitwiseXOR(F.lit(mask)))
    groups = stored(groups.select("key", "size", "pivot", "least"), "jaccard-groups")
    as_larger = (F.col("least") <= F.col("n")) & (
        (100 + similarity_percent) * F.col("room") >= similarity_percent * (F.col("n") + F.col("least"))
    )
    met = _with_group(rows, groups, "key", total).filter(as_smaller | as_larger)
    met = stored(met.drop("size", "least"), "jaccard-met")
    return met, met.count()


def _star_pairs(met: DataFrame, info: DataFrame, similarity_percent: int) -> DataFrame:
    """For each set that pivot of another component that it shares most keys with: a (the pivot), b."""
    pairs = met.filter("sid <> pivot").groupBy("sid", "n", "label", "pivot")
    pairs = pairs.agg(F.count("*").alias("times"), F.max("room").alias("room"))
    other = info.select(F.col("sid").alias("pivot"), *[F.col(c).alias(f"_{c}") for c in ("n", "shared", "label")])
    pairs = pairs.join(other, "pivot").filter("label <> _label")
    pairs = pairs.filter(_can_be_similar(similarity_percent, "n", "room", "_n", "_shared"))
    best = pairs.groupBy("sid").agg(F.max(F.struct("times", "pivot")).alias("best"))
    return best.select(F.col("best.pivot").alias("a"), F.col("sid").alias("b"))


def _pairs_left(
    met: DataFrame, labels: DataFrame | None, held: DataFrame, texts: DataFrame, words: int, similarity_percent: int, total: int, blocks: int
) -> DataFrame:
    """Pairs of sets of different components, those with a link among them: a, b.

    Sets with a link have it at the first key they share, so no pair is missed. The sets of a key's most
    frequent component don't meet each other, so the pairs are those of the others with all that have
    room for a link there. At a key of many sets these would be too many: there the sets meet again
    at keys of their differences to one of them.
    """
    rows = met.select("key", "sid", "n", (2 * similarity_percent * F.col("n")).alias("need"), "room", "label", F.col("label").alias("was"))
    found = None
    for level in range(LEVELS + 1):
        counted = rows.groupBy("key", "label").agg(F.count("*").alias("times"))
        most = counted.groupBy("key").agg(F.max(F.struct("times", "label")).alias("most"), F.sum("times").alias("size"), F.count("*").alias("labels"))
        most = stored(most.filter("labels > 1").select("key", "size", F.col("most.label").alias("major")), "jaccard-majors")
        rows = _with_group(rows, most, "key", total)
        narrow = rows if level == LEVELS else rows.filter(F.col("size") <= WIDE)
        few = narrow.filter("label <> major").select("key", *[F.col(c).alias(f"_{c}") for c in ("sid", "need", "room", "label", "was")])
        pairs = narrow.join(few, "key").filter("label <> _label and was <> _was and (label = major or sid < _sid)")
        pairs = pairs.filter(2 * (100 + similarity_percent) * F.least("room", "_room") >= F.col("need") + F.col("_need"))
        pairs = stored(pairs.select(F.least("sid", "_sid").alias("a"), F.greatest("sid", "_sid").alias("b")).distinct(), "jaccard-met-pairs")
        found = pairs if found is None else found.unionByName(pairs)
        if level == LEVELS or most.filter(F.col("size") > WIDE).isEmpty():
            break
        stars = _stars(rows.filter(F.col("size") > WIDE).drop("size").join(held, "sid"), total, similarity_percent)
        apart = _differences(stars, labels, texts, words, similarity_percent, blocks)
        linked = apart.filter("linked and was <> pivot_label")
        found = found.unionByName(linked.select(F.least("sid", "pivot").alias("a"), F.greatest("sid", "pivot").alias("b")))
        rows, total = _difference_keys(apart, similarity_percent)
    return found.distinct()


def _stars(rows: DataFrame, total: int, similarity_percent: int) -> DataFrame:
    """For all sets at a key with a pivot of about their size: a (the pivot), b.

    Sets are in two of the overlapping ranges of sizes, so that two with a link are in one range and have its pivot.
    That is the set whose elements most sets have, so most differ little from it.
    """
    step = 1.001 * math.log(100 / similarity_percent)
    size = F.floor(F.log("n") / step)
    rows = rows.withColumn("range", F.explode(F.array(size, size + 1))).withColumn("key", F.xxhash64("key", "range"))
    middle = F.struct(F.col("label") == F.col("major"), "held", "sid")
    groups = rows.groupBy("key").agg(
        F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"), F.max(middle).alias("pivot")
    )
    groups = stored(groups.filter("low < high").select("key", "size", F.col("pivot.sid").alias("pivot")), "jaccard-ranges")
    stars = _with_group(rows.select("key", "sid"), groups, "key", 2 * total).filter("sid <> pivot")
    return stored(stars.select(F.col("pivot").alias("a"), F.col("sid").alias("b")).distinct(), "jaccard-stars")


def _differences(
    stars: DataFrame, labels: DataFrame | None, texts: DataFrame, words: int, similarity_percent: int, blocks: int
) -> DataFrame:
    """pivot, sid, n, need, linked, elements (in only one of both), was, pivot_label, label of all pairs.

    With the symmetric differences D and E of two sets to a pivot and their sizes n and m, the two are
    linked if (100 + similarity) * (|D| + |E| - 2 |D and E|) <= (100 - similarity) * (n + m), that is, the
    sum of both ``need`` is at most 2 * (100 + similarity) * |D and E|. Unless both are
    linked to the pivot, that sum is positive. Sets linked to the pivot take its label here.
    """

    def differ(pivot: np.ndarray, own: np.ndarray) -> tuple[int, int, np.ndarray]:
        return len(own), len(pivot), np.setxor1d(pivot, own, assume_unique=True).view(np.int64)

    found = _compared(stars, texts, words, blocks, differ, "n long, m long, elements array<long>")
    found = found.withColumnsRenamed({"a": "pivot", "b": "sid"})
    need = (100 + similarity_percent) * F.size("elements").cast("bigint") - (100 - similarity_percent) * F.col("n")
    found = found.withColumn("need", need).withColumn("linked", F.col("need") <= (100 - similarity_percent) * F.col("m"))
    found = _labelled(found.withColumnsRenamed({"sid": "other", "pivot": "sid"}), labels)
    found = _labelled(found.withColumnsRenamed({"sid": "pivot", "label": "pivot_label", "other": "sid"}), labels)
    found = found.withColumnRenamed("label", "was").withColumn("label", F.when(F.col("linked"), F.col("pivot_label")).otherwise(F.col("was")))
    return stored(found, "jaccard-differences")


def _difference_keys(apart: DataFrame, similarity_percent: int) -> tuple[DataFrame, int]:
    """Rows of the differences at which sets of several components meet with room for a link, and how many they are."""
    columns = ["pivot", "sid", "n", "need", "linked", "label", "was"]
    entries = apart.select(*columns, F.explode("elements").alias("element"))
    entries = entries.select(*columns, F.xxhash64("pivot", "element").alias("key"))
    lists = entries.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"))
    lists = stored(lists.filter("low < high").select("key", "size"), "jaccard-difference-lists")
    total = lists.agg(F.sum("size")).first()[0] or 0
    found = _with_group(entries, lists, "key", total).groupBy(*columns)
    found = found.agg(F.sort_array(F.collect_list(F.struct("size", "key"))).alias("keys"))
    found = found.select(*columns, F.size("keys").alias("many"), F.posexplode("keys").alias("place", "at"))
    room = (F.col("many") - F.col("place")).cast("bigint")
    rows = found.select(*columns[1:], F.col("at.key").alias("key"), room.alias("room"))
    rows = rows.withColumn("offer", 2 * (100 + similarity_percent) * F.col("room") - F.col("need"))
    # Of two sets one isn't linked to the pivot, and each offers what the other needs.
    rows = stored(rows, "jaccard-difference-rows")
    groups = rows.groupBy("key").agg(
        F.count("*").alias("size"),
        F.min("need").alias("least"),
        F.max("offer").alias("best"),
        F.min(F.when(~F.col("linked"), F.col("need"))).alias("least_apart"),
        F.max(F.when(~F.col("linked"), F.col("offer"))).alias("best_apart"),
    )
    groups = stored(groups.filter("best >= least_apart"), "jaccard-difference-groups")
    met = _with_group(rows, groups, "key", total)
    fits = F.when(F.col("linked"), F.expr("offer >= least_apart and need <= best_apart")).otherwise(F.expr("offer >= least and need <= best"))
    met = stored(met.filter(fits).select("key", "sid", "n", "need", "room", "label", "was"), "jaccard-difference-met")
    return met, met.count()


def _texts(documents: DataFrame, candidates: DataFrame, representatives: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """sid and text of the sets that may have links, each from a document with that set."""
    wanted = representatives.select("sid", "doc_id").join(candidates, "sid").groupBy("doc_id").agg(F.collect_set("sid").alias("_sids"))
    rows = documents.select(F.col(quoted(key)).alias("doc_id"), F.col(quoted(text)).cast("string").alias("_text"))
    met = small_or_salted(rows.filter("doc_id is not null"), stored(wanted, "jaccard-ids"), "doc_id").filter("_sids is not null")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids = [set_hash(shingle_set(value.as_py(), words)) for value in batch.column(0)]
            hit = [sid in own for sid, own in zip(sids, batch.column(1).to_pylist(), strict=True)]
            rows = pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), batch.column(0)], names=["sid", "text"])
            yield rows.filter(pa.array(hit, pa.bool_()))

    return stored(met.select("_text", "_sids").mapInArrow(keep, "sid long, text string"), "jaccard-texts")


def _compared(
    pairs: DataFrame, texts: DataFrame, words: int, blocks: int, result: Callable[[np.ndarray, np.ndarray], tuple | None], columns: str
) -> DataFrame:
    """a, b and the result's columns of the pairs (a, b) of which the full sets have one.

    Sets are dealt to blocks by hash. For each two blocks with pairs, the sets of the one are
    held, those of the other pass by, so a text moves once for each block it meets and a task
    holds one block.
    """

    def block(of: str) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(blocks)).alias(f"block_{of}")

    dealt = pairs.select("a", "b", block("a"), block("b"))
    place = ["block_a", "block_b"]
    held = dealt.select(*place, F.col("a").alias("sid")).distinct().withColumn("others", F.lit(None).cast("array<long>"))
    passing = dealt.groupBy(*place, F.col("b").alias("sid")).agg(F.collect_list("a").alias("others"))
    rows = held.unionByName(passing).join(texts, "sid").select(*place, F.col("others").isNotNull().alias("passes"), "sid", "text", "others")
    rows = rows.repartition(*place).sortWithinPartitions(*place, "passes", "sid")
    schema = ", ".join(x for x in ("a long, b long", columns) if x)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, {}
        for batch in batches:
            found = []
            columns = [batch.column(k).to_pylist() for k in (0, 1, 3, 5)]
            for block_a, block_b, sid, others, text in zip(*columns, batch.column(4), strict=True):
                if now != (block_a, block_b):
                    now, sets = (block_a, block_b), {}
                own = shingle_set(text.as_py(), words)
                if others is None:
                    sets[sid] = own
                    continue
                for a in others:
                    more = result(sets[a], own)
                    if more is not None:
                        found.append((a, sid, *more))
            if found:
                kinds = [pa.list_(pa.int64()) if "array" in c else pa.int64() for c in schema.split(", ")]
                arrays = [pa.array(list(x), kind) for x, kind in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(compare, schema)


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, similarity_percent: int, blocks: int) -> DataFrame:
    """Those of the pairs (a, b) of which the full sets are similar."""

    def similar(one: np.ndarray, other: np.ndarray) -> tuple | None:
        both = len(np.intersect1d(one, other, assume_unique=True))
        return () if 100 * both >= similarity_percent * (len(one) + len(other) - both) else None

    return _compared(pairs, texts, words, blocks, similar, "")


def _classes(
    documents: DataFrame, representatives: DataFrame, words: int, similarity_percent: int, key: str, text: str
) -> DataFrame | None:
    """The sets that have links, each with the label of what links connect: uid, label. None if there are none."""
    texts = _texts(documents, _candidates(representatives, similarity_percent), representatives, words, key, text)
    shared = _shared(texts, words, similarity_percent)
    border = boundary([tuple(r) for r in _costs(shared, similarity_percent).collect()])
    keys = _keys(shared, border, similarity_percent)
    total = keys.count()
    if not total:
        return None
    info = shared.select("sid", "n", "shared")
    blocks = math.ceil(shared.agg(F.sum("n")).first()[0] / BLOCK_ELEMENTS)
    links = labels = None
    for turn in range(ROUNDS + 1):
        if turn == ROUNDS:
            # A pair of sets with much in common meets at far fewer lists than subsets.
            keys = _keys(shared, -1, similarity_percent)
            total = keys.count()
        met, total = _mixed(_labelled(keys, labels), int(_ROUND_MASKS[turn]), total, similarity_percent)
        if turn == ROUNDS:
            pairs = _pairs_left(met, labels, shared.select("sid", "held"), texts, words, similarity_percent, total, blocks)
        else:
            pairs = _star_pairs(met, _labelled(info, labels), similarity_percent)
        found = checkpointed(confirmed(stored(pairs, "jaccard-pairs"), texts, words, similarity_percent, blocks))
        # Keys at which only one component is left stay so.
        keys = met.drop("pivot", "label")
        if not found.isEmpty():
            links = found if links is None else checkpointed(links.unionByName(found))
            labels = stored(components(links), "jaccard-labels")
    return labels


def similar_documents(documents: DataFrame, words: int = 5, similarity_percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The classes of documents that links of similar shingle sets connect: doc_id, n_shingles, component_id.

    A document's set holds the shingles of ``words`` words of its whole lower-cased (A to Z)
    text; with fewer words all of them are its only shingle. Sets whose intersection is ``similarity_percent``
    of their union or more are linked. ``component_id`` is the smallest id that links reach, the document's own included.

    Null, empty and white texts have no shingles and no link. Equal sets are one set with all
    their documents. Rows with equal ids and different texts are linked by their texts only. A row without an id
    joins the component of a row with the same set, else its component_id is null; it links nothing itself.
    Further columns are left out.
    """
    if similarity_percent <= 50:
        raise ValueError("the similarity is more than one half")
    sets = stored(_with_sets(documents, words, key, text), "jaccard-sets")
    counted = sets.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    copied = stored(counted.filter("copies > 1").select("sid", "low"), "jaccard-copied")
    one = small_or_salted(sets.filter("sid is not null and doc_id is not null"), copied, "sid")
    one = one.filter("low is null or doc_id = low").select("doc_id", "sid", F.col("n_shingles").alias("n"), "sample")
    representatives = stored(one, "jaccard-one")
    labels = _classes(documents, representatives, words, similarity_percent, key, text)
    ids = copied.select("sid", F.col("low").alias("component_id"))
    if labels is not None:
        named = representatives.select("sid", F.col("doc_id").alias("low")).join(labels.withColumnRenamed("uid", "sid"), "sid")
        named = stored(named, "jaccard-named")
        lows = named.groupBy("label").agg(F.min("low").alias("component_id"))
        linked = named.join(lows, "label").select("sid", "component_id").distinct()
        ids = linked.unionByName(ids.join(linked.select("sid"), "sid", "left_anti"))
    found = small_or_salted(sets.drop("sample"), stored(ids, "jaccard-ids"), "sid")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
