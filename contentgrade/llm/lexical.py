"""Ranked lexical search: item vocabulary tiles times document impact tiles, by dense products.

Scores are whole numbers. A product of float64 tiles is exact as long as no partial sum
reaches 2**53, so the vocabulary is cut into tiles for which that is certain, whatever
documents come; the sums of tiles are added as 64-bit integers.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contentgrade.llm.common import quoted, stored

# A term is a stretch of ASCII letters, digits and characters beyond ASCII.
TERM = rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Fixed values of the score: impacts lie below IMPACT, saturate by SATURATION, and LENGTH
# per cent of the length norm follow the length of the document.
IMPACT = 1_000_000
SATURATION = 8
LENGTH = 75
WEIGHT = 1000

EXACT = (1 << 53) - 1
# Items are searched in blocks of at most so many, and about so many bytes of text.
BLOCK_ITEMS = 512
BLOCK_BYTES = 4 << 20
TILE_TERMS = 1024
TILE_DOCS = 1024

_terms = re.compile(TERM).findall


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order; only A to Z are lower-cased."""
    return _terms((text or "").encode("utf-8", "surrogatepass").lower())


@dataclass(frozen=True)
class Tile:
    """Term numbers and the weight of each (items by terms) that a product takes at once."""

    terms: np.ndarray
    weights: np.ndarray


def tiles(
    item: np.ndarray, term: np.ndarray, count: np.ndarray, weight: np.ndarray, items: int, width: int, exact: int = EXACT
) -> list[Tile]:
    """Cut weights (``count`` times the term's ``weight``) into tiles of exact partial sums.

    No sum over a tile's terms of an item's weight times the largest impact exceeds ``exact``.
    A term that an item repeats so often that it alone would is spread over several tiles.
    """
    limit = exact // IMPACT
    order = np.lexsort((item, term))
    found: list[Tile] = []
    terms: list[int] = []
    columns: list[np.ndarray] = []
    held = np.zeros(items, dtype=np.int64)

    def close() -> None:
        if terms:
            found.append(Tile(np.array(terms), np.array(columns, dtype=np.float64).T.copy()))
            terms.clear()
            columns.clear()
            held[:] = 0

    borders = np.flatnonzero(np.diff(term[order], prepend=-1, append=-1))
    for start, end in zip(borders, borders[1:], strict=False):
        rows = order[start:end]
        number, one = int(term[rows[0]]), int(weight[term[rows[0]]])
        if not one:
            continue
        left = count[rows].astype(np.int64)
        while left.any():
            taken = np.minimum(left, limit // one)
            if len(terms) >= width or (held[item[rows]] + taken * one > limit).any():
                close()
            column = np.zeros(items, dtype=np.int64)
            column[item[rows]] = taken * one
            held += column
            terms.append(number)
            columns.append(column)
            left -= taken
    close()
    return found


def length_norm(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    return 100 - LENGTH + (LENGTH * n * documents) // total


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What one occurrence in an item is worth, but for the term's weight; below ``IMPACT``."""
    return (1000 * IMPACT * tf) // (1000 * tf + SATURATION * norm)


def scores(parts: list[Tile], items: int, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int) -> np.ndarray:
    """Scores of items by documents, from the entries of the documents sorted by term."""
    total = np.zeros((items, docs), dtype=np.int64)
    for tile in parts:
        lo = np.searchsorted(term, tile.terms)
        hi = np.searchsorted(term, tile.terms, side="right")
        present = np.flatnonzero(hi > lo)
        if not len(present):
            continue
        sizes = (hi - lo)[present]
        entries = np.repeat(lo[present] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        block = np.zeros((len(present), docs))
        block[np.repeat(np.arange(len(present)), sizes), doc[entries]] = impact[entries]
        total += (tile.weights[:, present] @ block).astype(np.int64)
    return total


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best per row, equal scores by ascending id."""
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _item_blocks(items: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """Distinct items with a block number each: blocks follow the size of the items, which is measured."""
    kept = items.select(F.col(quoted(key)).alias("item_id"), F.col(quoted(text)).cast("string").alias("text"))
    kept = kept.filter("text is not null").distinct()
    count, size = kept.agg(F.count("*"), F.sum(F.octet_length("text").cast("bigint"))).first()
    blocks = max(1, math.ceil(2 * count / BLOCK_ITEMS), math.ceil(2 * (size or 0) / BLOCK_BYTES))
    return stored(kept.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "lexical-items"), blocks


def _entries(documents: DataFrame, vocabulary, key: str, text: str) -> DataFrame:
    """doc_id, n (terms with repeats) and, of the terms in the vocabulary, numbers and frequencies."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = vocabulary.value
        for batch in batches:
            n, found, often = [], [], []
            for value in batch.column(1):
                terms = terms_of(value.as_py())
                n.append(len(terms))
                known = np.array([numbers[t] for t in terms if t in numbers], dtype=np.int32)
                term, tf = np.unique(known, return_counts=True)
                found.append(term)
                often.append(tf)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(found, kind), pa.array([x.astype(np.int32) for x in often], kind)],
                names=["doc_id", "n", "terms", "tfs"],
            )

    rows = documents.select(F.col(quoted(key)).cast("bigint").alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


def _search(entries: DataFrame, searched, k: int) -> DataFrame:
    """The best documents of each task for each item: item, doc_id, score."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, items, documents, total = searched.value
        best, best_ids = np.zeros((items, 0), dtype=np.int64), np.zeros((items, 0), dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_DOCS):
                tile = batch.slice(start, TILE_DOCS)
                ids = tile.column(0).to_numpy()
                lists = tile.column(2)
                sizes = np.diff(lists.offsets.to_numpy())
                term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                tf = tile.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(ids)), sizes)
                norm = length_norm(tile.column(1).to_numpy(), documents, total)
                impact = impacts(tf, norm[doc]).astype(np.float64)
                order = np.argsort(term, kind="stable")
                score = scores(parts, items, term[order], doc[order], impact[order], len(ids))
                if len(ids) > k:
                    # Everything that reaches the kth best score stays, then ties go by id.
                    least = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
                    some = np.flatnonzero((score >= np.maximum(least, 1)[:, None]).any(axis=0))
                    score, ids = score[:, some], ids[some]
                here = best_of(score, np.broadcast_to(ids, score.shape), k)
                best, best_ids = best_of(np.hstack([best, here[0]]), np.hstack([best_ids, here[1]]), k)
        item, place = np.nonzero(best > 0)
        if len(item):
            yield pa.RecordBatch.from_arrays(
                [pa.array(item.astype(np.int32)), pa.array(best_ids[item, place]), pa.array(best[item, place])],
                names=["item", "doc_id", "score"],
            )

    return entries.mapInArrow(search, "item int, doc_id long, score long")


def _block(spark: SparkSession, documents: DataFrame, items: DataFrame, k: int, key: str, text: str) -> DataFrame | None:
    """Search for one block of items. What the driver holds and sends out is the terms of a block."""
    rows = [(r["item_id"], terms_of(r["text"])) for r in items.collect()]
    rows = [(item, terms) for item, terms in rows if terms]
    if not rows:
        return None
    numbers: dict[bytes, int] = {}
    item, term, count = [], [], []
    for i, (_, terms) in enumerate(rows):
        known = [numbers.setdefault(t, len(numbers)) for t in terms]
        for number, times in zip(*np.unique(known, return_counts=True), strict=True):
            item.append(i)
            term.append(number)
            count.append(times)
    vocabulary = spark.sparkContext.broadcast(numbers)
    entries = stored(_entries(documents, vocabulary, key, text), "lexical-entries")
    held, total = entries.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not held:
        return None
    df = np.zeros(len(numbers), dtype=np.int64)
    for number, n in entries.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[number] = n
    weight = np.array([math.floor(WEIGHT * math.log((2 * held + 2) / (2 * int(n) + 1))) for n in df], dtype=np.int64)
    parts = tiles(np.array(item), np.array(term), np.array(count), weight, len(rows), TILE_TERMS)
    searched = spark.sparkContext.broadcast((parts, len(rows), held, total))
    found = _search(entries.filter("doc_id is not null"), searched, k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    kind = items.schema["item_id"].dataType
    names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(rows)], f"item int, item_id {kind.simpleString()}")
    found = stored(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "lexical-found")
    vocabulary.unpersist()
    searched.unpersist()
    return found


def search_lexical(
    documents: DataFrame,
    items: DataFrame,
    k: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The ``k`` best documents for each item, of all documents: item_id, rank, doc_id, score.

    Only documents with a score above 0 are listed; equal scores go by ascending doc_id.
    Scores are sums over an item's terms, repeats included, of the term's weight times its
    impact in the document, all in whole numbers (see ``length_norm``, ``impacts`` and ``WEIGHT``).

    Items come in blocks of ``BLOCK_ITEMS`` and ``BLOCK_BYTES`` of text; for each block, all documents
    are read once, and only the block's terms are counted and kept. A task keeps its ``k``
    best of each item, which then meet per item.

    A null or empty text, or one without terms, is no document for the counts and never
    found; such an item has no rows. A document without an id counts but isn't listed. Rows
    with equal ids are documents of their own. Equal items are one; of two texts with one
    item_id each has its own rows. Further columns are left out.
    """
    spark = documents.sparkSession
    kept, blocks = _item_blocks(items, item_key, item_text)
    found = [_block(spark, documents, kept.filter(F.col("block") == b), k, key, text) for b in range(blocks)]
    found = [f for f in found if f is not None]
    if found:
        return reduce(DataFrame.unionByName, found)
    kind = kept.schema["item_id"].dataType.simpleString()
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
