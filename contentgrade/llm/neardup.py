"""Near-duplicate documents by a chosen-path similarity join over MinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentgrade.llm.common import checkpointed, small_or_salted, sorted_groups, stored
from contentgrade.llm.components import components

COORDINATES = 128
# Nodes of up to so many documents are compared exhaustively.
LEAF = 1024
# Nodes of up to so many leaves are cut into blocks, of which every two are a leaf.
BLOCKED = 2
MAX_LEVELS = 5

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_random = np.random.Generator(np.random.PCG64(20240607))
_MULTIPLY = _random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 1 << 64, COORDINATES, dtype=np.uint64)
_ORDER = _random.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown when a longer text comes."""

    base: np.ndarray
    inverse: np.ndarray

    def up_to(self, n: int) -> None:
        if n > len(self.base):
            self.base, self.inverse = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, dtype=np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


_grown = Powers(_powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (a public finaliser of three shifts and two products)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a lower-cased text, in order.

    Sums of bytes times powers of a base run over the whole text; the difference of two of
    them, divided by the power at the word's beginning, depends on the word alone.
    """
    a = np.frombuffer(text, dtype=np.uint8)
    if not len(a):
        return np.empty(0, dtype=np.uint64)
    _grown.up_to(len(a) + 1)
    inside = ~_SPACE[a]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _grown.base[: len(a)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _grown.inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles of so many words.

    A text of fewer words has one shingle, all of it; a null text or one without words none.
    Only A to Z are lower-cased.
    """
    hashes = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(hashes):
        return hashes
    n = min(words, len(hashes))
    total = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        total += hashes[k : len(hashes) - n + 1 + k] * _ORDER[k]
    return np.unique(mix(total + np.uint64(n)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The upper halves of the smallest values under ``COORDINATES`` random functions."""
    smallest = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), 4096):
        part = shingles[start : start + 4096]
        np.minimum(smallest, (part[None, :] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1), out=smallest)
    return (smallest >> np.uint64(32)).astype("<u4")


def brief(signs: np.ndarray) -> np.ndarray:
    """A byte of each coordinate, enough to compare two documents: one in 256 agree by chance."""
    return signs.astype(np.uint8)


def matrix(column: pa.Array, kind: str = "<u4") -> np.ndarray:
    """Signatures of a binary column as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, COORDINATES)


def children(nodes: np.ndarray, signatures: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and child nodes: where each row goes from its node.

    Every node chooses coordinates by a hash of its own, each with a probability of one in
    ``similarity`` times their number, and one at least; a row goes to a child for each
    chosen coordinate, named by its value there.
    """
    unique, which = np.unique(nodes, return_inverse=True)
    draws = mix(unique.view(np.uint64)[:, None] ^ mix(np.arange(1, COORDINATES + 1, dtype=np.uint64))[None, :])
    chosen = draws < np.uint64(int((1 << 64) / (similarity * COORDINATES)))
    chosen[np.arange(len(unique)), draws.argmin(axis=1)] = True
    rows, coordinate = np.nonzero(chosen[which])
    parents = nodes[rows].view(np.uint64)
    value = signatures[rows, coordinate].astype(np.uint64)
    name = mix(mix(parents + np.uint64(_BASE) * (coordinate + 1).astype(np.uint64)) ^ mix(value))
    return rows, name.view(np.int64)


def _signed(documents: DataFrame, words: int, text: str) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set, a hash of the text, the signature and its brief form."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, group, signs, short = [], [], [], []
            for value in batch.column(2):
                shingles = shingle_set(value.as_py(), words)
                n.append(len(shingles))
                group.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                signed = signature(shingles) if len(shingles) else None
                signs.append(None if signed is None else signed.tobytes())
                short.append(None if signed is None else brief(signed).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), *[pa.array(x, pa.binary()) for x in (group, signs, short)]],
                names=["doc_id", "uid", "n_shingles", "set_hash", "signature", "brief"],
            )

    rows = documents.select("doc_id", F.xxhash64(text).alias("uid"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(sign, f"doc_id {kind}, uid long, n_shingles long, set_hash binary, signature binary, brief binary")


def _roots(representatives: DataFrame, trees: int, similarity: float) -> DataFrame:
    """The first level of all trees: node and uid."""

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(_BASE)).view(np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            signs, uids = matrix(batch.column(1)), batch.column(0).to_numpy()
            for root in roots:
                rows, nodes = children(np.full(len(uids), root), signs, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(uids[rows])], names=["node", "uid"])

    return representatives.select("uid", "signature").mapInArrow(branch, "node long, uid long")


def _next_level(rows: DataFrame, similarity: float) -> DataFrame:
    """Children of large nodes: the documents not linked to the pivot, by their own minwise values."""

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, child = children(batch.column(0).to_numpy(), matrix(batch.column(2)), similarity)
                yield pa.RecordBatch.from_arrays([pa.array(child), batch.column(1).take(pa.array(at))], names=["node", "uid"])

    return rows.select("node", "uid", "signature").mapInArrow(branch, "node long, uid long")


def _margin(similarity: float) -> float:
    """The least agreement of signatures that is looked at: four standard deviations below."""
    return similarity - 4 * float(np.sqrt(similarity * (1 - similarity) / COORDINATES))


def _reach(similarity: float) -> float:
    """The least agreement with a pivot of what can be similar to a document linked to it.

    One less the similarity is a metric, so such a document is at most twice as far away.
    """
    return _margin(max(0.0, 2 * similarity - 1))


def _needed(n: np.ndarray, d: np.ndarray, similarity: float) -> np.ndarray:
    """Agreement of the differences to a pivot that two documents of this similarity have.

    ``n`` is the sum of the sizes of both sets and ``d`` that of both differences. The sets
    differ in what is in one of the differences only, so sizes and the agreement tell
    their similarity.
    """
    shared = (d - n * (1 - similarity) / (1 + similarity)) / 2
    return shared / np.maximum(d - shared, 1)


def _candidates(group: pa.RecordBatch, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of different components whose signatures agree enough, and how much more.

    In a group of two sides, signatures are those of differences to a pivot, and a pair has a
    row of each.
    """
    comps, signs = group.column(2).to_numpy(), matrix(group.column(3), "u1")
    side, n, d = (group.column(k).to_numpy() for k in (4, 5, 6))
    halves = bool(len(side)) and side[-1] > 0
    border = int(np.searchsorted(side, 2)) if halves else len(comps) - 1
    first, second, excess = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0)]
    for i in range(border):
        start = border if halves else i + 1
        same = (signs[start:] == signs[i]).sum(axis=1)
        if halves:
            needed = _needed(n[start:] + n[i], d[start:] + d[i], similarity)
            within = np.clip(needed, 0, 1)
            least = COORDINATES * (within - 4 * np.sqrt(within * (1 - within) / COORDINATES))
            enough = (same >= least) & (needed <= 1)
            over = same - COORDINATES * needed
        else:
            enough, over = same >= _margin(similarity) * COORDINATES, same
        near = np.flatnonzero(enough & (comps[start:] != comps[i]))
        first.append(np.full(len(near), i))
        second.append(near + start)
        excess.append(over[near].astype(float))
    return np.concatenate(first), np.concatenate(second), np.concatenate(excess)


def forest(a: np.ndarray, b: np.ndarray, order: np.ndarray, comps: np.ndarray) -> list[int]:
    """Which of the pairs, taken in an order, join components not yet joined."""
    parent = {int(c): int(c) for c in comps}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    kept = []
    for k in order:
        x, y = root(int(comps[a[k]])), root(int(comps[b[k]]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(int(k))
    return kept


def _dealt(leaves: DataFrame) -> DataFrame:
    rows = leaves.select("node", "uid", "comp", "brief", "side", "n", "d").repartition("node")
    return rows.sortWithinPartitions("node", "side", "uid")


def _forest_pairs(leaves: DataFrame, similarity: float) -> DataFrame:
    """Of each node the pairs that a spanning forest of the most similar candidates needs."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches):
            a, b, over = _candidates(group, similarity)
            if not len(a):
                continue
            uids = group.column(1).to_numpy()
            kept = forest(a, b, np.lexsort((uids[b], uids[a], -over)), group.column(2).to_numpy())
            x, y = uids[a[kept]], uids[b[kept]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return _dealt(leaves).mapInArrow(compare, "a long, b long").filter("a != b").distinct()


def _open_members(leaves: DataFrame, similarity: float) -> DataFrame:
    """The documents of each node that have a candidate of another component there."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches):
            a, b, _ = _candidates(group, similarity)
            if len(a):
                yield group.take(pa.array(np.unique(np.concatenate([a, b])))).select(["node", "uid", "comp"])

    return _dealt(leaves).mapInArrow(compare, "node long, uid long, comp long")


def intersections(sets: list[np.ndarray], columns: int = 8192, held: int = 1 << 21) -> np.ndarray:
    """How many shingles each two of the sorted sets share, from products of blocks of their matrix.

    The hashes are taken range by range, so that about ``held`` of them are looked at at once.
    """
    total = np.zeros((len(sets), len(sets)))
    ranges = max(1, -(-sum(map(len, sets)) // held))
    for k in range(ranges):
        low, high = ((1 << 64) * x // ranges for x in (k, k + 1))
        parts = [
            s[np.searchsorted(s, np.uint64(low)) : np.searchsorted(s, np.uint64(high)) if k + 1 < ranges else len(s)]
            for s in sets
        ]
        rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        _, place, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared = n > 1
        number = np.cumsum(shared) - 1
        used = shared[place]
        rows, place = rows[used], number[place[used]]
        order = np.argsort(place, kind="stable")
        rows, place = rows[order], place[order]
        for start in range(0, int(shared.sum()), columns):
            lo, hi = np.searchsorted(place, (start, start + columns))
            block = np.zeros((len(sets), columns), dtype=np.float32)
            block[rows[lo:hi], place[lo:hi] - start] = 1
            total += block @ block.T
    return total


def _one_text(documents: DataFrame, wanted: DataFrame, representatives: DataFrame, text: str) -> DataFrame:
    """Rows of ``wanted`` with the text of their uid, taken from one document of that text."""
    wanted = stored(wanted.join(representatives.select("uid", F.col("doc_id").alias("_doc")), "uid"), "near-wanted")
    texts = documents.select(F.xxhash64(text).alias("uid"), F.col("doc_id"), F.col(text).cast("string").alias("_text"))
    met = small_or_salted(texts, wanted.withColumn("_wanted", F.lit(True)), "uid")
    return met.filter(F.col("_wanted") & F.col("doc_id").eqNullSafe(F.col("_doc"))).drop("doc_id", "_doc", "_wanted")


def verify_nodes(
    documents: DataFrame, members: DataFrame, representatives: DataFrame, words: int, similarity_percent: int, text: str
) -> DataFrame:
    """Links between documents of different components that meet in a node, on full sets.

    A document goes once to each node, however many pairs it is in there, and a node returns
    no more links than join its components.
    """
    met = _one_text(documents, members, representatives, text)
    dealt = met.select("node", "uid", "comp", "_text").repartition("node").sortWithinPartitions("node", "uid")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches):
            uids, first = np.unique(group.column(1).to_numpy(), return_index=True)
            comps = group.column(2).to_numpy()[first]
            sets = [shingle_set(group.column(3)[int(i)].as_py(), words) for i in first]
            if len(sets) < 2:
                continue
            sizes = np.array([len(s) for s in sets])
            both = intersections(sets)
            linked = 100 * both >= similarity_percent * (sizes[:, None] + sizes[None, :] - both)
            a, b = np.nonzero(np.triu(linked & (comps[:, None] != comps[None, :]), 1))
            kept = forest(a, b, np.arange(len(a)), comps)
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(uids[a[kept]]), pa.array(uids[b[kept]])], names=["a", "b"])

    return stored(dealt.mapInArrow(check, "a long, b long"), "near-links")


def verify(
    documents: DataFrame,
    pairs: DataFrame,
    representatives: DataFrame,
    words: int,
    similarity_percent: int,
    text: str,
    deltas: bool = False,
    chunk: int = 256,
) -> DataFrame:
    """Pairs ``a``, ``b`` with whether their full shingle sets are similar enough.

    A group is a document ``a`` with some of its partners, by a hash if there are more than
    ``chunk``, so one with very many is compared in many tasks; a task holds one set and
    streams the others past it. With ``deltas`` come along the sizes ``m`` and ``n`` of both sets
    and ``d`` of their difference, the shingles that are in one set only, and the brief form of
    the signature of that difference.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / chunk).alias("salts"))
    salted = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").alias("salt"))
    centres = salted.select(F.col("a").alias("uid"), F.col("a").alias("centre"), "salt", F.lit(0).alias("side")).distinct()
    wanted = centres.unionByName(
        salted.select(F.col("b").alias("uid"), F.col("a").alias("centre"), "salt", F.lit(1).alias("side"))
    )
    met = _one_text(documents, wanted, representatives, text)
    dealt = met.select(F.xxhash64("centre", "salt").alias("group"), "side", "centre", "uid", "_text")
    dealt = dealt.repartition("group").sortWithinPartitions("group", "side", "uid")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, last = None, None, None
        for batch in batches:
            out: list[tuple] = []
            for key, side, centre, uid, value in zip(*batch.columns, strict=True):
                key, uid = key.as_py(), uid.as_py()
                if key != group:
                    group, held, last = key, None, None
                if side.as_py() == 0:
                    held = shingle_set(value.as_py(), words) if held is None else held
                    continue
                if uid == last:
                    continue
                last = uid
                other = shingle_set(value.as_py(), words)
                both = len(np.intersect1d(held, other, assume_unique=True))
                linked = 100 * both >= similarity_percent * (len(held) + len(other) - both)
                delta = brief(signature(np.setxor1d(held, other, assume_unique=True))).tobytes() if deltas else None
                sizes = len(held), len(other), len(held) + len(other) - 2 * both
                out.append((centre.as_py(), uid, linked, *sizes, delta))
            if out:
                long, binary = pa.int64(), pa.binary()
                columns = zip(zip(*out, strict=True), (long, long, pa.bool_(), long, long, long, binary), strict=True)
                names = ["a", "b", "linked", "m", "n", "d", "brief"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=names)

    schema = "a long, b long, linked boolean, m long, n long, d long, brief binary"
    return stored(dealt.mapInArrow(check, schema), "near-verified")


def _pivots(inside: DataFrame, sample: int = 64) -> DataFrame:
    """Of each large node the document of a sample by hash that agrees most with the others.

    It is a guess at what copies were made from. Any pivot is right; one from the middle is
    similar to more documents, and they differ from it in fewer shingles.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches):
            signs = matrix(group.column(2))
            agree = np.array([(signs == s).sum() for s in signs])
            at = int(agree.argmax())
            yield group.slice(at, 1)

    few = inside.filter(F.pmod(F.xxhash64("node", "uid"), F.ceil(F.col("n") / sample)) == 0)
    few = few.select("node", "uid", "signature").repartition("node").sortWithinPartitions("node", "uid")
    chosen = few.mapInArrow(choose, "node long, uid long, signature binary")
    return chosen.select("node", F.col("uid").alias("pivot"), F.col("signature").alias("pivot_signature"))


def _agreement(rows: DataFrame) -> DataFrame:
    """Add in how many coordinates ``signature`` and ``pivot_signature`` agree."""

    @F.pandas_udf("int")
    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(a), dtype="<u4").reshape(len(a), -1)
        y = np.frombuffer(b"".join(b), dtype="<u4").reshape(len(b), -1)
        return pd.Series((x == y).sum(axis=1).astype(np.int32))

    return rows.withColumn("agree", agree("signature", "pivot_signature"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Cut nodes of ``n`` documents into blocks of half a leaf, and name each pair of blocks."""
    blocks = F.ceil(F.col("n") / (LEAF / 2)).cast("int")
    cut = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("uid"), blocks).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other"))
    return cut.select(pair.alias("node"), "uid")


def _crossed(found: DataFrame, similarity_percent: int, level: int) -> DataFrame:
    """Blocks of documents linked to a pivot with those that aren't but may be similar to one that is.

    ``found`` is what comparing with pivots gave, so a document is in it once a pivot. Each
    block of one side meets each of the other; a node is two blocks of up to about a leaf.
    """
    least = 2 * similarity_percent - 100
    total = F.col("m") + F.col("n")
    rows = found.filter(F.col("linked") | (100 * (total - F.col("d")) >= least * (total + F.col("d"))))
    counts = rows.groupBy("a").agg(F.count_if("linked").alias("inner"), F.count_if(~F.col("linked")).alias("outer"))
    counts = counts.filter("inner > 0 and outer > 0").select(
        "a", *[F.ceil(F.col(c) / LEAF).cast("int").alias(c) for c in ("inner", "outer")]
    )
    met = small_or_salted(rows, stored(counts, "near-sides"), "a").filter("inner is not null")
    own = F.when(F.col("linked"), F.col("inner")).otherwise(F.col("outer"))
    others = F.when(F.col("linked"), F.col("outer")).otherwise(F.col("inner"))
    cut = met.withColumn("block", F.pmod(F.xxhash64("b"), own).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    sides = F.when(F.col("linked"), F.struct("block", F.col("other").alias("facing"))).otherwise(
        F.struct(F.col("other").alias("block"), F.col("block").alias("facing"))
    )
    return cut.select(
        F.xxhash64(F.lit(level), "a", sides).alias("node"),
        F.col("b").alias("uid"),
        F.when(F.col("linked"), F.col("a")).otherwise(F.col("b")).alias("comp"),
        "brief",
        F.when(F.col("linked"), F.lit(2)).otherwise(F.lit(1)).alias("side"),
        "n",
        "d",
    )


def near_links(
    documents: DataFrame,
    representatives: DataFrame,
    words: int,
    similarity_percent: int,
    trees: int,
    text: str,
) -> DataFrame:
    """Links between representatives that connect every group of similar ones.

    All trees grow together, a level at a time. A small node is a leaf and is compared
    exhaustively. In a large node a pivot, one of its documents, is compared with all others
    and leaves, and so do those confirmed to be similar to it: they are one component, and
    what else may be similar to one of them, which is near the pivot too, is compared with
    all of them, block by block, through the differences to the pivot. The others branch by
    chosen minwise values. So a group of copies that are similar to one of them costs a
    comparison per document and level, not per pair. Nodes of a few leaves, and those still
    large at the last level, are cut into blocks, and every pair of blocks is a leaf.
    """
    similarity = similarity_percent / 100
    signs, briefs = representatives.select("uid", "signature"), representatives.select("uid", "brief")
    rows = stored(_roots(representatives, trees, similarity), "near-nodes")
    leaves: list[DataFrame] = []
    sides: list[DataFrame] = []
    links: list[DataFrame] = []
    for level in range(MAX_LEVELS + 1):
        nodes = checkpointed(rows.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"))
        leaves.append(rows.join(nodes.filter(F.col("n") <= LEAF).select("node"), "node"))
        large = nodes.filter(F.col("n") > BLOCKED * LEAF)
        last = level == MAX_LEVELS or large.isEmpty()
        middle = nodes.filter(F.col("n") > LEAF)
        if not last:
            middle = middle.filter(F.col("n") <= BLOCKED * LEAF)
        leaves.append(_blocks(rows.join(middle, "node")))
        if last:
            break
        inside = small_or_salted(rows, large.withColumn("_large", F.lit(True)), "node").filter("_large").drop("_large")
        inside = stored(inside.join(signs, "uid"), "near-inside")
        pivots = stored(_pivots(inside), "near-pivots")
        inside = inside.drop("n")
        met = small_or_salted(inside, pivots, "node").filter("uid != pivot")
        met = stored(_agreement(met).drop("pivot_signature"), "near-level")
        close = F.col("agree") >= _reach(similarity) * COORDINATES
        pairs = met.filter(close).select(F.col("pivot").alias("a"), F.col("uid").alias("b")).distinct()
        found = verify(documents, pairs, representatives, words, similarity_percent, text, deltas=True)
        links.append(found.filter("linked").select("a", "b"))
        sides.append(_crossed(found, similarity_percent, level))
        known = found.filter("linked").select(F.col("a").alias("pivot"), F.col("b").alias("uid"))
        rows = stored(_next_level(met.join(known, ["pivot", "uid"], "left_anti"), similarity), "near-nodes")
    small = leaves[0]
    for more in leaves[1:]:
        small = small.unionByName(more)
    small = small.withColumn("comp", F.col("uid")).join(briefs, "uid")
    small = small.select("node", "uid", "comp", "brief", F.lit(0).alias("side"), *[F.lit(0).cast("long").alias(c) for c in "nd"])
    for more in sides:
        small = small.unionByName(more)
    small = stored(small, "near-leaves")
    pairs = stored(_forest_pairs(small, similarity), "near-forest")
    checked = verify(documents, pairs, representatives, words, similarity_percent, text)
    links.append(checked.filter("linked").select("a", "b"))
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    # What the forest left out matters only between documents that it didn't join.
    labels = components(found)
    labelled = small.drop("comp").join(labels, "uid", "left").withColumn("comp", F.coalesce("label", "uid")).drop("label")
    open_nodes = labelled.groupBy("node").agg((F.min("comp") != F.max("comp")).alias("open")).filter("open").select("node")
    members = stored(_open_members(labelled.join(open_nodes, "node"), similarity), "near-open")
    return found.unionByName(verify_nodes(documents, members, representatives, words, similarity_percent, text))


def near_duplicates(
    documents: DataFrame,
    words: int = 5,
    similarity_percent: int = 80,
    trees: int = 8,
    text: str = "text",
) -> DataFrame:
    """Components of documents whose sets of word shingles are similar, a row per document.

    Two documents are linked if 100 times the size of the intersection of their sets is at
    least ``similarity_percent`` times that of the union; candidates come from ``trees``
    independent chosen-path trees over MinHash signatures and every link is confirmed on the
    full sets. Documents of equal sets are one vertex, however many they are.

    Returns doc_id, n_shingles, component_id (the smallest doc_id of the component) and kept
    (whether that is the document's own). A document without words is linked with nothing. A
    null doc_id is larger than all others and only names a component of nothing but null
    ids. Rows of equal id and text are one document. Other columns aren't looked at, and an
    empty table gives an empty table.
    """
    signed = stored(_signed(documents, words, text), "near-signed")
    full = signed.filter("set_hash is not null")
    ids = full.groupBy("set_hash").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("first_id"))
    ids = stored(ids, "near-sets")
    chosen = full.join(ids.select("set_hash", F.col("uid").alias("_uid")), "set_hash").filter("uid = _uid")
    representatives = stored(
        chosen.groupBy("uid").agg(
            F.first("signature").alias("signature"), F.first("brief").alias("brief"), F.min("doc_id").alias("doc_id")
        ),
        "near-representatives",
    )
    links = near_links(documents, representatives, words, similarity_percent, trees, text)
    labels = components(links)
    joined = ids.join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    least = joined.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_set = stored(joined.join(least, "label").select("set_hash", "component_id"), "near-components")
    placed = small_or_salted(signed.select("doc_id", "n_shingles", "set_hash"), by_set, "set_hash")
    component = F.coalesce("component_id", "doc_id")
    return placed.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
