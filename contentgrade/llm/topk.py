"""Exact top-k inner products by a dual traversal of cover trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentgrade.llm.common import stored
from contentgrade.llm.vectors import by_length, ranked, rows_of, usable

# Queries go to the tasks in sets of about so many; a set is all that the driver ever holds.
QUERY_SET = 32_768
# Data are indexed in blocks of so many rows.
BLOCK_ROWS = 8_192
# A leaf has enough rows for the products of two leaves to outweigh the steps of the walk.
LEAF = 512
CHILDREN = 12


@dataclass(slots=True)
class Node:
    """A point that covers all rows below it within the radius."""

    rows: np.ndarray
    centre: np.ndarray
    length: float
    radius: float
    children: list["Node"] = field(default_factory=list)
    worst: float = -np.inf


def build(points: np.ndarray, rows: np.ndarray | None = None, centre: int | None = None) -> Node:
    """A cover tree: the children's centres are rows, far from each other, and cover all rows.

    Centres are taken farthest first until they cover the rows within half the radius or are
    ``CHILDREN`` many; every row goes to the nearest.
    """
    rows = np.arange(len(points)) if rows is None else rows
    centre = int(rows[0]) if centre is None else centre
    at = points[centre]
    far = np.sqrt(((points[rows] - at) ** 2).sum(axis=1))
    node = Node(rows, at, float(np.sqrt(at @ at)), float(far.max()))
    if len(rows) <= LEAF or node.radius == 0:
        return node
    centres, nearest, best = [centre], np.zeros(len(rows), dtype=int), far.copy()
    while len(centres) < CHILDREN and best.max() > node.radius / 2:
        new = int(rows[best.argmax()])
        d = np.sqrt(((points[rows] - points[new]) ** 2).sum(axis=1))
        closer = d < best
        nearest[closer], best[closer] = len(centres), d[closer]
        centres.append(new)
    if len(centres) == 1:
        # All rows lie within half of the radius but its outermost: part them in two.
        new = int(rows[far.argmax()])
        nearest[((points[rows] - points[new]) ** 2).sum(axis=1) < far**2] = 1
        centres.append(new)
    for i, c in enumerate(centres):
        inside = rows[nearest == i]
        if len(inside):
            node.children.append(build(points, inside, c))
    return node


def _exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of whole-numbered rows: in doubles or 64-bit integers where no sum can leave them, else in Python's.

    What doesn't fit in 64 bits becomes the number nearest to it that does.
    """
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**52:
        return a @ b.T
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a) @ whole(b).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class DualSearch:
    """The best of all rows seen so far for each query, by integer score and then by id."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, versions: np.ndarray, k: int, seeds: int = 512):
        self.points, self.ids, self.versions, self.k = points, ids, versions, k
        self.tree = build(points) if len(points) else None
        self.scores: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(points)
        self.found: list[np.ndarray] = [np.empty((0, 2), dtype=np.int64)] * len(points)
        self.floor = np.full(len(points), -np.inf)
        # Queries are rows too: the kth best of some of them is a score that the kth best reaches.
        others = points[:seeds]
        if len(others) > k:
            for start in range(0, len(points), 4096):
                s = _exact_products(points[start : start + 4096], others).astype(float)
                own = np.arange(start, min(start + 4096, len(points)))
                inside = own < len(others)
                s[np.flatnonzero(inside), own[inside]] = -np.inf
                self.floor[start : start + len(s)] = np.partition(s, -k, axis=1)[:, -k]

    def _worst(self, node: Node) -> float:
        """The lowest score that a pair still has to reach for some query of the node."""
        if node.children:
            node.worst = min(c.worst for c in node.children)
        else:
            node.worst = float(self.floor[node.rows].min())
        return node.worst

    def _refresh(self, node: Node) -> float:
        for c in node.children:
            self._refresh(c)
        return self._worst(node)

    @staticmethod
    def _bound(a: Node, b: Node) -> float:
        """No pair of rows below two nodes has a larger product."""
        return float(a.centre @ b.centre) + a.length * b.radius + b.length * a.radius + a.radius * b.radius

    def add(self, data: np.ndarray, ids: np.ndarray, versions: np.ndarray) -> None:
        """Index a block of rows and search it for all queries together."""
        if self.tree is None or not len(data):
            return
        self._refresh(self.tree)
        tree = build(data)
        order = 0
        heap = [(-self._bound(self.tree, tree), order, self.tree, tree)]
        while heap:
            bound, _, q, d = heapq.heappop(heap)
            bound = -bound
            slack = 1e-9 * abs(bound) + 1e-3
            if bound + slack < (self._worst(q) if not q.children else q.worst):
                continue
            if not q.children and not d.children:
                self._leaves(q, d, data, ids, versions)
                continue
            if d.children and (d.radius >= q.radius or not q.children):
                pairs = [(q, c) for c in d.children]
            else:
                pairs = [(c, d) for c in q.children]
                q.worst = min(c.worst for c in q.children)
            for a, b in pairs:
                most = self._bound(a, b)
                if most + 1e-9 * abs(most) + 1e-3 >= a.worst:
                    order += 1
                    heapq.heappush(heap, (-most, order, a, b))

    def _leaves(self, q: Node, d: Node, data: np.ndarray, ids: np.ndarray, versions: np.ndarray) -> None:
        products = _exact_products(self.points[q.rows], data[d.rows])
        reach = products >= self.floor[q.rows, None]
        for i in np.flatnonzero(reach.any(axis=1)):
            row = int(q.rows[i])
            near = np.flatnonzero(reach[i])
            near = near[(ids[d.rows[near]] != self.ids[row]) | (versions[d.rows[near]] != self.versions[row])]
            if not len(near):
                continue
            scores = np.concatenate([self.scores[row], products[i, near].astype(np.int64)])
            found = np.vstack([self.found[row], np.stack([ids[d.rows[near]], versions[d.rows[near]]], axis=1)])
            best = np.lexsort((found[:, 1], found[:, 0], -scores))[: self.k]
            self.scores[row], self.found[row] = scores[best], found[best]
            if len(best) == self.k:
                self.floor[row] = max(self.floor[row], float(scores[best[-1]]))
        self._worst(q)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: int = 1024,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """For each query row the ``k`` rows of the largest integer inner products, exactly.

    A component x counts as floor(``scale`` * x). The rows stay where they are: a task builds
    a cover tree over each block of its rows and walks it together with the tree of the
    queries, dropping pairs of nodes that cannot reach the worst kth score of the queries
    below. Queries are sent out in sets of about ``QUERY_SET`` by a hash of their id, one pass
    over the rows per set, so the work is that of a stated query set against all rows in
    blocks. A task returns at most ``k`` rows per query.

    Returns query_id, rank (from 1), vec_id and score; ties go to the smaller vec_id. Rows
    left out are those of :func:`vectors.usable` (zero vectors take part); rows of equal id and vector
    are one. A query is answered from the vectors of its own length, whatever lengths there are: a
    task has a tree of queries per length. Scores of components of any size are exact; one beyond 64 bits is given as the
    largest or smallest 64-bit number.
    """
    rows = usable(vectors, key, vector, zeros=True)

    def whole(x: Column) -> Column:
        scaled = F.lit(float(scale)) * x
        return F.when(F.abs(scaled) < 2.0**53, F.floor(scaled).cast("double")).otherwise(scaled)

    rows = rows.withColumn("vec", F.transform("vec", whole))
    rows = stored(rows, "topk-vectors")
    chosen = vectors.filter(is_query).select(F.col(key).cast("bigint").alias("vec_id")).distinct()
    queries = stored(rows.join(chosen, "vec_id", "left_semi"), "topk-queries")
    sets = max(1, -(-queries.count() // QUERY_SET))
    results: list[DataFrame] = []
    for number in range(sets):
        table = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(sets)) == number).orderBy("vec_id", "version").toArrow()
        shared = rows.sparkSession.sparkContext.broadcast(
            {
                n: (rows_of(part.column("vec")), part.column("vec_id").to_numpy(), part.column("version").to_numpy())
                for batch in table.combine_chunks().to_batches()
                for n, part in by_length(batch, batch.schema.get_field_index("vec")).items()
            }
        )

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            duals: dict[int, DualSearch] = {}
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK_ROWS):
                    for n, part in by_length(batch.slice(start, BLOCK_ROWS), 2).items():
                        if n not in duals:
                            if n not in shared.value:
                                continue
                            duals[n] = DualSearch(*shared.value[n], k)
                        duals[n].add(rows_of(part.column(2)), part.column(0).to_numpy(), part.column(1).to_numpy())
            for dual in duals.values():
                n = [len(s) for s in dual.scores]
                if not sum(n):
                    continue
                found = np.vstack(dual.found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(dual.ids, n)),
                        pa.array(np.repeat(dual.versions, n)),
                        pa.array(found[:, 0]),
                        pa.array(found[:, 1]),
                        pa.array(np.concatenate(dual.scores)),
                    ],
                    names=["query_id", "query_version", "vec_id", "version", "score"],
                )

        results.append(
            rows.select("vec_id", "version", "vec").mapInArrow(
                search, "query_id long, query_version long, vec_id long, version long, score long"
            )
        )
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return ranked(found, k)
