"""Approximate nearest neighbours with balanced posting lists and a graph over centroids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentgrade.llm.common import sorted_groups, stored
from contentgrade.llm.vectors import ranked, rows_of, usable

# The centroids are fitted on the rows of the smallest hashes, so many at most; all rows are indexed.
SAMPLE = 32_768
LIST_ROWS = 64
MAX_LISTS = 4_096
# Lists are searched in groups of about so many rows, for about so many queries at a time.
PART_ROWS = 16_384
QUERY_ROWS = 4_096
# Lengths of vectors that so few rows have are searched whole; every other length has its own index.
FEW_ROWS = 1_024
DEGREE = 24
BEAM = 96


@dataclass
class Centroids:
    """Centroids of the posting lists, a neighbour graph over them and the entries into it."""

    points: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    longest: float

    def lifted(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """One more component makes the largest inner product the smallest distance."""
        if query:
            norm = np.linalg.norm(vectors, axis=1, keepdims=True)
            return np.hstack([vectors / np.where(norm > 0, norm, 1) * self.longest, np.zeros((len(vectors), 1))])
        rest = np.maximum(self.longest**2 - (vectors**2).sum(axis=1), 0)
        return np.hstack([vectors, np.sqrt(rest)[:, None]])

    def nearest(self, vectors: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids by beam search in the graph: ids and distances, nearest first.

        All vectors of the batch move at once: a round expands the best few centroids that
        each has not yet expanded, and the search ends when all in the beams are expanded.
        """
        k = len(self.points)
        beam = min(beam, k)
        length = (self.points**2).sum(axis=1)
        own = (vectors**2).sum(axis=1)[:, None]

        def distance(ids: np.ndarray) -> np.ndarray:
            dots = np.einsum("bd,bnd->bn", vectors, self.points[ids])
            return np.maximum(own + length[ids] - 2 * dots, 0)

        starts = np.maximum(own + length[self.entries] - 2 * vectors @ self.points[self.entries].T, 0)
        order = np.argsort(starts, axis=1, kind="stable")[:, :beam]
        ids = self.entries[order]
        far = np.take_along_axis(starts, order, axis=1)
        if ids.shape[1] < beam:
            missing = beam - ids.shape[1]
            ids = np.hstack([ids, np.full((len(ids), missing), -1)])
            far = np.hstack([far, np.full((len(far), missing), np.inf)])
        done = ~np.isfinite(far)
        seen = np.zeros((len(ids), k + 1), dtype=bool)  # the last column stands for no centroid
        at = np.arange(len(ids))[:, None]
        seen[at, ids] = True
        turns = max(4, beam // 16)
        while not done.all():
            turn = np.where(done, np.inf, far)
            best = np.argsort(turn, axis=1, kind="stable")[:, :turns]
            live = np.isfinite(np.take_along_axis(turn, best, axis=1))
            np.put_along_axis(done, best, True, axis=1)
            opened = np.where(live, np.take_along_axis(ids, best, axis=1), 0)
            more = np.where(live[:, :, None], self.graph[opened], -1).reshape(len(ids), -1)
            more = np.sort(more, axis=1)
            more[:, 1:][more[:, 1:] == more[:, :-1]] = -1
            fresh = (more >= 0) & ~seen[at, more]
            seen[at, np.where(fresh, more, -1)] = True
            width = int(fresh.sum(axis=1).max())
            if not width:
                continue
            order = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
            more, fresh = np.take_along_axis(more, order, axis=1), np.take_along_axis(fresh, order, axis=1)
            d = np.where(fresh, distance(np.where(fresh, more, 0)), np.inf)
            ids = np.hstack([ids, np.where(fresh, more, -1)])
            far = np.hstack([far, d])
            done = np.hstack([done, ~fresh])
            order = np.argsort(far, axis=1, kind="stable")[:, :beam]
            ids, far, done = (np.take_along_axis(x, order, axis=1) for x in (ids, far, done))
        return ids, np.sqrt(far)


def fit_centroids(sample: np.ndarray, n_rows: int, longest: float, seed: int = 7) -> Centroids:
    """Balanced k-means on the sample: lists above twice the mean are split in each round."""
    shell = Centroids(np.empty((0, 0)), np.empty((0, 0), int), np.empty(0, int), longest)
    x = shell.lifted(sample, query=False)
    k = int(max(1, min(np.ceil(n_rows / LIST_ROWS), MAX_LISTS, len(x))))
    random = np.random.default_rng(seed)
    points = x[random.choice(len(x), k, replace=False)].copy()
    for step in range(10):
        label = np.empty(len(x), dtype=int)
        for start in range(0, len(x), 4096):
            part = x[start : start + 4096]
            label[start : start + 4096] = ((points**2).sum(axis=1) - 2 * part @ points.T).argmin(axis=1)
        size = np.bincount(label, minlength=k)
        sums = np.zeros_like(points)
        np.add.at(sums, label, x)
        filled = size > 0
        points[filled] = sums[filled] / size[filled, None]
        if step < 8:
            heavy = [c for c in np.argsort(-size) if size[c] > max(2 * len(x) / k, 2)]
            light = [c for c in np.argsort(size) if size[c] < 0.5 * len(x) / k]
            for c, target in zip(heavy, light, strict=False):
                members = np.flatnonzero(label == c)
                points[target] = x[random.choice(members)]
    near = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2) if k <= 512 else None
    degree = min(DEGREE, k)
    if near is not None:
        graph = np.argsort(near, axis=1, kind="stable")[:, :degree]
    else:
        length = (points**2).sum(axis=1)
        graph = np.vstack(
            [
                np.argsort(length - 2 * points[a : a + 512] @ points.T, axis=1, kind="stable")[:, :degree]
                for a in range(0, k, 512)
            ]
        )
    # Entries lie far from each other, so every cluster of centroids has one.
    entries = [0]
    gap = ((points - points[0]) ** 2).sum(axis=1)
    while len(entries) < min(k, 64):
        entries.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[entries[-1]]) ** 2).sum(axis=1))
    return Centroids(points, graph, np.array(sorted(set(entries))), longest)


def boundary_lists(far: np.ndarray, ratio: float, copies: int) -> np.ndarray:
    """Which of the nearest lists a vector goes to: the first, and those hardly further away."""
    chosen = far[:, :copies] <= ratio * far[:, :1] + 1e-12
    chosen[:, 0] = True
    return chosen


def calibrate(
    centroids: Centroids, sample: np.ndarray, k: int, boundary_ratio: float, copies: int, recall: float, queries: int = 256
) -> tuple[float, int]:
    """The distance ratio at which lists are pruned, measured against brute force.

    For some of the sample as queries, the nearest rows of the sample are found exactly, and
    for each the ratio at which the first list that holds it would be searched. Returned are
    the ratio that reaches ``recall`` of them and the number of lists within it. Neighbours in
    a sample are further away than those among all rows, so the ratio is on the safe side.
    """
    queries = min(queries, len(sample))
    if len(sample) < 2:
        return np.inf, len(centroids.points)
    lifted, asked = centroids.lifted(sample, False), centroids.lifted(sample[:queries], True)
    length = (centroids.points**2).sum(axis=1)
    to_list = np.maximum((asked**2).sum(axis=1)[:, None] + length - 2 * asked @ centroids.points.T, 0) ** 0.5
    relative = to_list / np.maximum(to_list.min(axis=1, keepdims=True), 1e-12)
    products = sample[:queries] @ sample.T
    products[np.arange(queries), np.arange(queries)] = -np.inf
    top = np.argsort(-products, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    found = [centroids.nearest(lifted[part]) for part in np.array_split(top.ravel(), -(-top.size // 256))]
    ids, far = (np.vstack([f[side] for f in found]) for side in (0, 1))
    chosen = boundary_lists(far, boundary_ratio, copies)
    ids = ids[:, : chosen.shape[1]]
    rows = np.repeat(np.arange(queries), top.shape[1])[:, None]
    needed = np.where(chosen & (ids >= 0), relative[rows, np.maximum(ids, 0)], np.inf).min(axis=1)
    ratio = float(np.quantile(needed, recall))
    return ratio, int(np.quantile((relative <= ratio).sum(axis=1), 0.99)) + 8


def _post(rows: DataFrame, centroids, ratio: float, copies: int) -> DataFrame:
    """A row per vector and list that holds it."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = centroids.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                ids, far = index.nearest(index.lifted(rows_of(part.column(2)), False))
                chosen = boundary_lists(far, ratio, copies) & (ids[:, :copies] >= 0)
                at, place = np.nonzero(chosen)
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(pa.array(at)) for c in part.columns], pa.array(ids[at, place].astype(np.int32))],
                    names=["vec_id", "version", "vec", "list"],
                )

    return rows.select("vec_id", "version", "vec").mapInArrow(assign, "vec_id long, version long, vec array<double>, list int")


def _probe(queries: DataFrame, centroids, sizes: np.ndarray, ratio: float, beam: int, least: int) -> DataFrame:
    """The lists that each query searches: those within the ratio, and no fewer than hold ``least`` rows."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = centroids.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                asked = index.lifted(rows_of(part.column(2)), True)
                ids, far = index.nearest(asked, beam)
                held = np.cumsum(np.where(ids >= 0, sizes[ids], 0), axis=1)
                if (held[:, -1] < least).any():
                    ids, far = index.nearest(asked, len(sizes))
                    held = np.cumsum(np.where(ids >= 0, sizes[ids], 0), axis=1)
                before = np.hstack([np.zeros((len(ids), 1), dtype=held.dtype), held[:, :-1]])
                chosen = (ids >= 0) & ((far <= ratio * far[:, :1] + 1e-12) | (before < least))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([r[c].tolist() for r, c in zip(ids, chosen, strict=True)], pa.list_(pa.int32()))],
                    names=["vec_id", "version", "vec", "lists"],
                )

    return queries.select("vec_id", "version", "vec").mapInArrow(
        choose, "vec_id long, version long, vec array<double>, lists array<int>"
    )


@dataclass
class Layout:
    """Where lists are searched: short ones share a group, long ones are cut into several."""

    group: np.ndarray
    parts: np.ndarray
    blocks: np.ndarray


def lay_out(points: np.ndarray, entries: np.ndarray, sizes: np.ndarray, asked: np.ndarray) -> Layout:
    """Neighbouring lists fill groups of up to ``PART_ROWS`` rows; a few numbers per list."""
    near = ((points**2).sum(axis=1)[:, None] + (points[entries] ** 2).sum(axis=1) - 2 * points @ points[entries].T).argmin(axis=1)
    group, parts, blocks = (np.zeros(len(sizes), dtype=np.int64) for _ in range(3))
    number, held, members = 0, 0, []

    def close() -> None:
        nonlocal number, held, members
        if members:
            blocks[members] = max(1, -(-int(asked[members].max()) // QUERY_ROWS))
            number += int(parts[members].max())
        held, members = 0, []

    for c in np.lexsort((np.arange(len(sizes)), near)):
        if held and held + sizes[c] > PART_ROWS:
            close()
        group[c], parts[c] = number, max(1, -(-int(sizes[c]) // PART_ROWS))
        members.append(c)
        held += sizes[c]
        if parts[c] > 1:
            close()
    close()
    return Layout(group, parts, blocks)


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    copies: int = 4,
    boundary_ratio: float = 1.06,
    recall: float = 0.96,
) -> DataFrame:
    """For each query row the ``k`` rows of the largest inner products that were found.

    Every vector is in the posting list of its nearest centroid, and near a boundary in up to
    ``copies`` lists. A query searches the lists whose centroids are no further than a ratio
    times the nearest; the ratio is measured on the sample so that the lists hold ``recall``
    of the true neighbours. Lists that together hold less than ``k`` other rows are never all
    that is searched. Lists are searched in groups of bounded size, long lists and lists that
    many queries search in several, by a hash, so no vector, however often it occurs, makes a
    long task. The driver holds the sample, the centroids and a few numbers per list.

    An inner product needs two vectors of one length, so a query is answered from the vectors of
    its own length. The most frequent length, and every other that more than ``FEW_ROWS`` rows
    have, gets an index of its own; the rest are compared whole, length by length.

    Returns query_id, rank (from 1), vec_id and score in double precision; ties go to the
    smaller vec_id. Rows that are left out are those of :func:`vectors.usable`, among them
    zero vectors; rows of equal id and vector are one. Other columns are not looked at.
    """
    rows = stored(usable(vectors, key, vector, zeros=False), "ann-vectors")
    chosen = vectors.filter(is_query).select(F.col(key).cast("bigint").alias("vec_id")).distinct()
    queries = rows.join(chosen, "vec_id", "left_semi")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    lengths = rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("held"), F.max(norm).alias("longest"))
    # A row per length that has an index, and the most frequent one always has.
    indexed = lengths.orderBy(F.desc("held"), "n").limit(1).unionByName(lengths.filter(F.col("held") > FEW_ROWS))
    found = []
    for r in indexed.distinct().orderBy(F.desc("held"), "n").collect():
        own = F.size("vec") == r["n"]
        found.append(
            _indexed(rows.filter(own), queries.filter(own), r["held"], r["longest"], k, copies, boundary_ratio, recall)
        )
        rows, queries = rows.filter(~own), queries.filter(~own)
    found.append(_compared(rows, queries, k))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return ranked(every, k)


FOUND = "query_id long, query_version long, vec_id long, version long, score double"


def _compared(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query of a rare length, from all rows of that length."""
    asked = queries.select("vec_id", "version").withColumn("asked", F.lit(True))
    sides = rows.join(asked, ["vec_id", "version"], "left").select(
        F.size("vec").alias("n"), F.coalesce("asked", F.lit(False)).alias("asked"), "vec_id", "version", "vec"
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sorted_groups(batches):
            ids, versions, x = part.column(2).to_numpy(), part.column(3).to_numpy(), rows_of(part.column(4))
            for q in np.flatnonzero(part.column(1).to_numpy(zero_copy_only=False)):
                scores = (x * x[q]).sum(axis=1)
                best = np.lexsort((versions, ids, -scores))
                best = best[best != q][:k]
                same = np.full(len(best), q)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (ids[same], versions[same], ids[best], versions[best], scores[best])],
                    names=["query_id", "query_version", "vec_id", "version", "score"],
                )

    return sides.repartition("n").sortWithinPartitions("n").mapInArrow(search, FOUND)


def _indexed(
    rows: DataFrame,
    queries: DataFrame,
    n: int,
    longest: float,
    k: int,
    copies: int,
    boundary_ratio: float,
    recall: float,
) -> DataFrame:
    """What an index over vectors of one length finds: at least the ``k`` best rows of each query's lists."""
    sample = rows.orderBy(F.xxhash64("vec_id", "version")).limit(SAMPLE).select("vec").toArrow()
    matrix = rows_of(sample.column("vec").combine_chunks())
    fitted = fit_centroids(matrix, n, longest)
    ratio, beam = calibrate(fitted, matrix, k, boundary_ratio, copies, recall)
    centroids = rows.sparkSession.sparkContext.broadcast(fitted)
    lists = len(fitted.points)
    postings = stored(_post(rows, centroids, boundary_ratio, copies), "ann-postings")
    sizes, asked = np.zeros(lists, dtype=np.int64), np.zeros(lists, dtype=np.int64)
    for r in postings.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    # A row is in ``copies`` lists at most, so these hold k others besides the query itself.
    probes = stored(_probe(queries, centroids, sizes, ratio, beam, copies * (k + 1)), "ann-probes")
    for r in probes.select(F.explode("lists").alias("list")).groupBy("list").count().collect():
        asked[r["list"]] = r["count"]
    layout = lay_out(fitted.points, fitted.entries, sizes, asked)

    def of_list(values: np.ndarray, at: Column) -> Column:
        return F.element_at(F.lit([int(v) for v in values]), at + 1).cast("bigint")

    place = F.xxhash64("vec_id", "version")
    held = postings.select(
        (of_list(layout.group, F.col("list")) + F.pmod(place, of_list(layout.parts, F.col("list")))).alias("group"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), of_list(layout.blocks, F.col("list")) - 1)).alias("block"),
        F.lit(0).alias("side"),
        "vec_id",
        "version",
        "vec",
        F.array("list").alias("lists"),
    )
    parts, blocks = of_list(layout.parts, F.col("list")), of_list(layout.blocks, F.col("list"))
    by_group = (
        probes.select("vec_id", "version", F.explode("lists").alias("list"))
        .select("*", of_list(layout.group, F.col("list")).alias("group"), parts.alias("parts"), blocks.alias("blocks"))
        .groupBy("vec_id", "version", "group")
        .agg(
            F.collect_list("list").alias("lists"),
            F.max("parts").alias("parts"),
            F.max("blocks").alias("blocks"),
        )
        .join(queries, ["vec_id", "version"])
    )
    searching = by_group.select(
        F.explode(F.sequence(F.col("group"), F.col("group") + F.col("parts") - 1)).alias("group"),
        F.pmod(place, "blocks").alias("block"),
        F.lit(1).alias("side"),
        "vec_id",
        "version",
        "vec",
        "lists",
    )
    met = held.unionByName(searching).withColumn("unit", F.xxhash64("group", "block"))
    met = met.select("unit", "side", "vec_id", "version", "vec", "lists")
    met = met.repartition("unit").sortWithinPartitions("unit", "side", "vec_id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sorted_groups(batches):
            cut = int(np.searchsorted(part.column(1).to_numpy(), 1))
            if cut == 0 or cut == part.num_rows:
                continue
            ids, versions = part.column(2).to_numpy(), part.column(3).to_numpy()
            x = rows_of(part.column(4))
            here, own_list = x[:cut], part.column(5).slice(0, cut).flatten().to_numpy()
            for start in range(cut, part.num_rows, 256):
                stop = min(start + 256, part.num_rows)
                wanted = np.zeros((stop - start, lists), dtype=bool)
                probed = part.column(5).slice(start, stop - start)
                wanted[np.repeat(np.arange(stop - start), probed.value_lengths().to_numpy()), probed.flatten().to_numpy()] = True
                allowed = wanted[:, own_list]
                allowed &= (ids[:cut] != ids[start:stop, None]) | (versions[:cut] != versions[start:stop, None])
                scores = np.where(allowed, x[start:stop] @ here.T, -np.inf)
                # A row is here once for each of its lists.
                few = min(k * copies, cut)
                worst = np.partition(scores, cut - few, axis=1)[:, cut - few]
                slack = np.where(np.isfinite(worst), 1e-9 * (np.abs(worst) + 1), 0)
                at, near = np.nonzero(allowed & (scores >= (worst - slack)[:, None]))
                # The same sum for every pair, so equal vectors tie exactly.
                exact = (here[near] * x[start:stop][at]).sum(axis=1)
                order = np.lexsort((versions[near], ids[near], -exact, at))
                at, near, exact = at[order], near[order], exact[order]
                again = np.zeros(len(at), dtype=bool)
                again[1:] = (at[1:] == at[:-1]) & (ids[near[1:]] == ids[near[:-1]]) & (versions[near[1:]] == versions[near[:-1]])
                at, near, exact = at[~again], near[~again], exact[~again]
                rank = np.arange(len(at)) - np.searchsorted(at, at)
                best = rank < k
                at, near, exact = at[best] + start, near[best], exact[best]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (ids[at], versions[at], ids[near], versions[near], exact)],
                    names=["query_id", "query_version", "vec_id", "version", "score"],
                )

    return met.mapInArrow(search, FOUND)
