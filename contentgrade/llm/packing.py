"""Packing documents into sequences of a fixed length by a configuration linear program."""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contentgrade.llm.common import checkpointed

END_ID = 2
PIECES = "piece int, start long, length long, ids_crc32 long"
# Texts are tokenized in parts of about so many characters, cut before a blank or line end
# that follows a letter or digit, where the vocabulary's rule always parts words.
PART_CHARS = 1 << 20
_CUT = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")


def tokenizer_path() -> str:
    """The default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Tokens:
    """Ids of the tokenizer in a JSON file.

    Texts without that file's special strings and without characters outside the basic plane
    go through a faster implementation of the same merges, built from the same file; the
    others go through the file's own library. Tests compare the two.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        self.special = [t["content"] for t in stored.get("added_tokens", ())]
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in set(plain)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {
            bytes(letters[c] for c in word): rank
            for word, rank in stored["model"]["vocab"].items()
            if word not in self.special
        }
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def own(self):
        """The file's own library, loaded when a text first needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def plain(self, text: str) -> bool:
        return not any(s in text for s in self.special) and (text.isascii() or max(text) <= "￿")

    def ids(self, text: str) -> np.ndarray:
        if not self.plain(text):
            return np.array(self.own.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if len(text) <= PART_CHARS:
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        parts, start = [], 0
        while start < len(text):
            cut = _CUT.search(text, start + PART_CHARS)
            end = cut.start() if cut else len(text)
            parts.append(np.array(self.fast.encode_ordinary(text[start:end]), dtype="<u4"))
            start = end
        return np.concatenate(parts)


_loaded: dict[str, Tokens] = {}


def _tokens(path: str) -> Tokens:
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


def cut_pieces(docs: DataFrame, capacity: int, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Tokenize whole texts and cut those of more than ``capacity`` ids.

    All pieces but the first have exactly ``capacity`` ids. A narrow step that yields a row
    of numbers per piece and no ids.
    """
    path = path or tokenizer_path()
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                ids = np.append(tokens.ids(value.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *[pa.array(x, pa.int64()) for x in (start, length, crc)],
                ],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(cut, f"`{key}` {kind}, {PIECES}")


def best_fillings(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room the largest worth of lengths that fit in, and a length to take first.

    The unbounded knapsack program; ``values[l]`` is the worth of length ``l`` (0: not used),
    a choice of 0 means that one place of the room stays free.
    """
    lengths = np.flatnonzero(values[: capacity + 1] > 0)
    best = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, dtype=np.int64)
    worth = values[lengths]
    usable = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        k = usable[room]
        if k:
            gains = best[room - lengths[:k]] + worth[:k]
            at = int(gains.argmax())
            if gains[at] > best[room]:
                best[room], choice[room] = gains[at], lengths[at]
    return best, choice


def filling(choice: np.ndarray, room: int) -> dict[int, int]:
    """The lengths that the program takes for a room, and how many of each."""
    found: dict[int, int] = defaultdict(int)
    while room > 0:
        length = int(choice[room])
        if length:
            found[length] += 1
        room -= length or 1
    return found


def solve_configurations(
    counts: np.ndarray, capacity: int, step: float = 0.02, eagerness: float = 1.0, near: float = 0.05, rounds: int = 400
) -> list[tuple[dict[int, int], float]]:
    """A fractional solution of the covering program by multiplicative weights.

    Every length has a weight: its size to begin with (the dual prices of packings without
    gaps), lowered by a factor as its pieces get covered. A round prices configurations by
    the knapsack program and uses the best one through each length, if it is within ``near``
    of the best of all, until it has covered ``step`` of its scarcest length. What the rounds
    leave uncovered is packed by :func:`pack_rest`.
    """
    counts = counts.astype(float)
    left = counts.copy()
    sizes = np.arange(len(counts), dtype=float)
    weights = np.where(counts > 0, sizes, 0.0)
    used: dict[tuple, float] = defaultdict(float)
    for _ in range(rounds):
        if left.sum() <= 0.001 * counts.sum():
            break
        best, choice = best_fillings(weights, capacity)
        lengths = np.flatnonzero(weights > 0)
        worth = weights[lengths] + best[capacity - lengths]
        spent = np.zeros(len(counts))
        for at in np.argsort(-worth * (1 + 1e-9 * lengths), kind="stable"):
            length = int(lengths[at])
            if worth[at] < (1 - near) * best[capacity]:
                break
            if spent[length] >= step * counts[length] or not left[length]:
                continue
            config = filling(choice, capacity - length)
            config[length] += 1
            times = min(min(step * counts[n] - spent[n], left[n]) / a for n, a in config.items())
            if times <= 0:
                continue
            used[tuple(sorted(config.items()))] += times
            for n, a in config.items():
                spent[n] += times * a
                left[n] -= times * a
                if left[n] < 1e-9:
                    left[n] = 0.0
        covered = np.divide(counts - left, counts, out=np.ones_like(counts), where=counts > 0)
        weights = np.where(left > 0, sizes * np.exp(-eagerness * covered), 0.0)
    return [(dict(c), x) for c, x in used.items()]


def pack_rest(bins: dict[tuple, int], counts: np.ndarray, capacity: int) -> dict[tuple, int]:
    """Add the remaining pieces to bins by best fit, longest first, many equal bins at a time."""
    open_bins: dict[int, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))
    for pattern, n in bins.items():
        open_bins[capacity - sum(length * a for length, a in pattern)][pattern] += n

    def put(pattern: tuple, length: int, times: int, n: int) -> None:
        inside = dict(pattern)
        inside[length] = inside.get(length, 0) + times
        changed = tuple(sorted(inside.items()))
        open_bins[capacity - sum(x * a for x, a in changed)][changed] += n

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left > 0:
            room = next((r for r in range(length, capacity) if open_bins[r]), None)
            if room is None:
                each = capacity // length
                if left >= each:
                    put((), length, each, left // each)
                    left %= each
                else:
                    put((), length, left, 1)
                    left = 0
                continue
            pattern, n = next(iter(open_bins[room].items()))
            taken = min(n, left)
            open_bins[room][pattern] -= taken
            if not open_bins[room][pattern]:
                del open_bins[room][pattern]
            put(pattern, length, 1, taken)
            left -= taken
    found: dict[tuple, int] = defaultdict(int)
    for group in open_bins.values():
        for pattern, n in group.items():
            found[pattern] += n
    return dict(found)


@dataclass
class PackingPlan:
    """Where the r-th piece of each length goes; its size depends on the capacity alone.

    For each length the arrays hold, by first rank: the first sequence of the block, the
    pieces of this length per sequence, and the offset of the first of them.
    """

    ranks: dict[int, np.ndarray]
    sequences: dict[int, np.ndarray]
    per_sequence: dict[int, np.ndarray]
    offsets: dict[int, np.ndarray]
    total: int

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = np.searchsorted(self.ranks[length], rank, side="right") - 1
        inside = rank - self.ranks[length][block]
        each = self.per_sequence[length][block]
        return self.sequences[length][block] + inside // each, self.offsets[length][block] + inside % each * length


def plan_packing(counts: dict[int, int], capacity: int) -> PackingPlan:
    """Solve the program over the histogram of lengths and round it to whole sequences."""
    by_length = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        by_length[length] = n
    rest = by_length.copy()
    rest[capacity] = 0
    bins: dict[tuple, int] = defaultdict(int)
    if by_length[capacity]:
        bins[((capacity, 1),)] = int(by_length[capacity])
    if rest.any():
        for config, times in solve_configurations(rest, capacity):
            whole = int(times + 1e-6)
            if whole:
                bins[tuple(sorted(config.items()))] += whole
                for length, a in config.items():
                    rest[length] -= whole * a
        bins = pack_rest(dict(bins), rest, capacity)
    blocks: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    filled: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, n in sorted(bins.items()):
        offset = 0
        for length, a in pattern:
            blocks[length].append((filled[length], sequence, a, offset))
            filled[length] += n * a
            offset += length * a
        sequence += n
    columns = {length: np.array(b, dtype=np.int64).T for length, b in blocks.items()}
    return PackingPlan(*[{n: c[i] for n, c in columns.items()} for i in range(4)], sequence)


def _rank_by_length(pieces: DataFrame) -> DataFrame:
    """Number the pieces of each length from 0 without gaps.

    Every partition numbers its own, and starts at the sum of the counts of the partitions
    before it, so a length that most pieces share stays spread.
    """
    schema = pieces.schema
    fields = [f.name for f in schema.fields]
    at = fields.index("length")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            rank = np.empty(batch.num_rows, dtype=np.int64)
            length = batch.column(at).to_numpy(zero_copy_only=False)
            order = np.argsort(length, kind="stable")
            values, firsts, n = np.unique(length[order], return_index=True, return_counts=True)
            for value, first, k in zip(values, firsts, n, strict=True):
                rank[order[first : first + k]] = seen[int(value)] + np.arange(k)
                seen[int(value)] += int(k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], names=[*fields, "_local"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    local = pieces.mapInArrow(number, f"{ddl}, _local long").withColumn("_part", F.spark_partition_id())
    counts = pieces.withColumn("_part", F.spark_partition_id()).groupBy("_part", "length").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return local.join(starts, ["_part", "length"]).select(*fields, (F.col("_before") + F.col("_local")).alias("_rank"))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Place pieces of lengths 1 to ``capacity`` in as few sequences as possible.

    The histogram of lengths, at most ``capacity`` rows, goes to the driver and comes back as
    a plan of configurations; every piece finds its place from its length and its number
    among the pieces of that length. Adds ``sequence_id`` and ``offset``.
    """
    pieces = checkpointed(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = pieces.sparkSession.sparkContext.broadcast(plan_packing(counts, capacity))
    ranked = _rank_by_length(pieces)
    fields = [f.name for f in pieces.schema.fields]
    at, rank_at = fields.index("length"), len(fields)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False)
            rank = batch.column(rank_at).to_numpy(zero_copy_only=False)
            sequence = np.zeros(len(length), dtype=np.int64)
            offset = np.zeros(len(length), dtype=np.int64)
            for value in np.unique(length):
                rows = length == value
                sequence[rows], offset[rows] = plan.value.place(int(value), rank[rows])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:rank_at], pa.array(sequence), pa.array(offset)], names=[*fields, "sequence_id", "offset"]
            )

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{ddl}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 1024, path: str | None = None) -> DataFrame:
    """Tokenize documents, add the end id, cut the long ones and pack all pieces.

    A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or
    empty text is the end id alone. Repeated rows and null ids are packed like any other; an
    empty table gives an empty table; other columns of the input are not looked at.
    """
    return pack(cut_pieces(docs, capacity, path), capacity)
