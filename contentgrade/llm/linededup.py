"""Line deduplication by a segment-partition edit-distance join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentgrade.llm.common import WORD, quoted, small_or_salted, stored
from contentgrade.llm.components import components

MAX_EDITS = 2
# Shorter lines are duplicates only if they are equal.
MIN_CHARS = 16
# Roles of a row: a segment of an indexed line, a substring of a probing line, or both.
INDEXED, PROBING, BOTH = 0, 1, 2
# Pairs whose distance is computed at once, and how many of a bucket are compared at once.
PAIRS = 2_048
PRODUCTS = 1 << 22

# A line's mark has its role in two bits, then parities of characters and of pairs of them.
CHAR_BITS, PAIR_BITS = 24, 38
_random = np.random.Generator(np.random.PCG64(11))
_CHARS = np.left_shift(np.int64(1), _random.integers(0, CHAR_BITS, 4099))
_PAIRS = np.left_shift(np.int64(1), _random.integers(CHAR_BITS, CHAR_BITS + PAIR_BITS, 4099))
_CHAR_MASK = np.int64((1 << CHAR_BITS) - 1)
_PAIR_MASK = np.int64(((1 << PAIR_BITS) - 1) << CHAR_BITS)
BLANKS = " \t\n\r\x0b\x0c"


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and size of the ``edits`` + 1 nearly equal parts of a line; the last are larger."""
    small, more = divmod(length, edits + 1)
    out, start = [], 0
    for i in range(edits + 1):
        size = small + (i > edits - more)
        out.append((start, size))
        start += size
    return out


@lru_cache(maxsize=8192)
def substrings(n: int, edits: int) -> tuple[list[tuple[int, int, int]], list[int]]:
    """Where a line of ``n`` characters is found by and looks for others, and the roles.

    A line that is at most ``edits`` away from a shorter or equally long one contains one of
    that one's segments, unchanged. Before the i-th segment there are at most i - 1 edits and
    after it at most ``edits`` + 1 - i if it is the first (or the last) to match, so only
    substrings that begin so near to the segment's own place are looked for. A place is first
    and last character and a seed for the other line's length and the segment's number.
    """
    places, roles = [], []
    for gap in range(edits + 1):
        length = n - gap
        if length < MIN_CHARS:
            break
        for i, (start, size) in enumerate(segments(length, edits)):
            first = max(start - i, start + gap - (edits - i), 0)
            last = min(start + i, start + gap + (edits - i), n - size)
            for at in range(first, last + 1):
                places.append((at, at + size, length * (edits + 1) + i))
                roles.append(BOTH if gap == 0 and at == start else PROBING)
    return places, roles


def keys_of(line: str, edits: int) -> list[tuple[int, int]]:
    """Hashes of the substrings of a line with their roles."""
    code = line.encode("utf-32-le", "surrogatepass")
    places, roles = substrings(len(code) // 4, edits)
    digest = xxhash.xxh64_intdigest
    return [(digest(code[4 * a : 4 * b], seed), role) for (a, b, seed), role in zip(places, roles, strict=True)]


def parities(line: str) -> int:
    """62 bits, each the parity of how often some characters, or neighbouring two, occur.

    An edit flips at most two of the first kind, and four of the second.
    """
    code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(code):
        return 0
    chars = np.bitwise_xor.reduce(_CHARS[code % np.uint32(4099)])
    pairs = np.bitwise_xor.reduce(_PAIRS[(code[:-1] * np.uint32(31) + code[1:]) % np.uint32(4099)]) if len(code) > 1 else 0
    return int(chars) | int(pairs)


def near_parities(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """Whether lines of such parities can be ``edits`` apart."""
    apart = a ^ b
    chars = np.bitwise_count(apart & _CHAR_MASK) <= 2 * edits
    return chars & (np.bitwise_count(apart & _PAIR_MASK) <= 4 * edits)


def line_hash(line: str) -> int:
    """What Spark's ``xxhash64`` gives for the line."""
    value = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
    return value - (1 << 64) if value >= 1 << 63 else value


def edit_distances(pairs: list[tuple[str, str]], edits: int) -> np.ndarray:
    """Levenshtein distances of pairs of strings, ``edits`` + 1 standing for anything larger.

    A pair is a lane of 64-bit words that hold the vertical differences of a band around the
    diagonal; a step advances all lanes by one character of their shorter strings.
    """
    lanes = len(pairs)
    # The band begins inside the strings, so all get a common beginning of its width.
    before = "." * edits
    pairs = [(before + a, before + b) if len(a) >= len(b) else (before + b, before + a) for a, b in pairs]
    n1 = np.array([len(a) for a, _ in pairs], dtype=np.int64)
    n2 = np.array([len(b) for _, b in pairs], dtype=np.int64)
    if not lanes:
        return np.empty(0, dtype=np.int64)
    # Rows beyond an end hold numbers that are no character.
    width = int(n1.max()) + 2 * edits + 1
    long = np.full((width, lanes), -1, dtype=np.int32)
    short = np.full((int(n2.max()) + 1, lanes), -2, dtype=np.int32)
    for k, (a, b) in enumerate(pairs):
        long[edits : edits + len(a), k] = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), dtype=np.int32)
        short[: len(b), k] = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    one = np.uint64(1)
    up = np.full(lanes, (0xFFFFFFFFFFFFFFFF << (63 - edits)) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    down = np.zeros(lanes, dtype=np.uint64)
    distance = np.full(lanes, edits, dtype=np.int64)
    corner = np.full(lanes, 62, dtype=np.uint64)
    for j in range(int(n2.max())):
        match = np.zeros(lanes, dtype=np.uint64)
        for k in range(2 * edits + 1):
            if j + k < width:
                match |= (long[j + k] == short[j]).astype(np.uint64) << np.uint64(63 - 2 * edits + k)
        diagonal = (((match & up) + up) ^ up) | match | down
        right = down | ~(diagonal | up)
        left = diagonal & up
        live = j < n2
        slanting = j < n1 - edits
        # First along the lower edge of the band, then along the last row of the longer string.
        distance += (live & slanting & ((diagonal >> np.uint64(63)) == 0)).astype(np.int64)
        flat = live & ~slanting
        distance += (flat & ((right >> corner) & one == 1)).astype(np.int64)
        distance -= (flat & ((left >> corner) & one == 1)).astype(np.int64)
        corner = np.where(flat, corner - one, corner)
        shifted = diagonal >> one
        up = left | ~(shifted | right)
        down = shifted & right
    return np.where(n1 - n2 > edits, edits + 1, np.minimum(distance, edits + 1))


def _lines(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, line_no, line and its hash; a null text has no lines."""
    exploded = docs.select("doc_id", F.posexplode(F.split(F.col(text).cast("string"), "\n", -1)).alias("line_no", "line"))
    return exploded.withColumn("hash", F.xxhash64("line"))


def _keys(docs: DataFrame, edits: int, text: str) -> DataFrame:
    """key, hash of the line, and its parities with the role; a line once per input partition."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        key, owner, marks = [], [], []

        def batch_of() -> pa.RecordBatch:
            keys, roles = (np.array(x, dtype=np.uint64).view(np.int64) for x in (key, marks))
            return pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(owner, pa.int64()), pa.array(roles)], names=["key", "hash", "mark"]
            )

        for batch in batches:
            for value in batch.column(0):
                for line in (value.as_py() or "").split("\n"):
                    if len(line) < MIN_CHARS or not line.strip(BLANKS):
                        continue
                    hashed = line_hash(line)
                    if hashed in seen:
                        continue
                    seen.add(hashed)
                    found = keys_of(line, edits)
                    bits = parities(line) << 2
                    key += [k for k, _ in found]
                    marks += [bits + role for _, role in found]
                    owner += [hashed] * len(found)
                if len(key) >= 100_000:
                    yield batch_of()
                    key, owner, marks = [], [], []
        if key:
            yield batch_of()

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(emit, "key long, hash long, mark long")


def _bucket_pairs(hashes: np.ndarray, marks: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of one bucket: an indexed and a probing line of nearly the same parities."""
    _, first = np.unique(np.stack([hashes, marks], axis=1), axis=0, return_index=True)
    hashes, marks = hashes[first], marks[first]
    role, bits = marks & 3, (marks >> 2) & (_CHAR_MASK | _PAIR_MASK)
    held, asking = np.flatnonzero(role != PROBING), np.flatnonzero(role != INDEXED)
    step = max(1, PRODUCTS // max(len(asking), 1))
    for start in range(0, len(held), step):
        part = held[start : start + step]
        near = near_parities(bits[part][:, None], bits[asking][None, :], edits)
        i, p = np.nonzero(near & (hashes[part][:, None] != hashes[asking][None, :]))
        if len(i):
            a, b = hashes[part[i]], hashes[asking[p]]
            yield np.minimum(a, b), np.maximum(a, b)


def candidate_pairs(docs: DataFrame, edits: int, text: str) -> DataFrame:
    """Pairs of hashes of lines that share a segment and differ in few parities.

    One shuffle brings segments and substrings of equal hash together; the rows then stream
    through in order, and only buckets that hold different lines are looked at. A bucket of
    very many lines is compared in blocks and gives only pairs that pass the parity test.
    """

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, dtype=np.int64)] * 3

        def run(keys: np.ndarray, hashes: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            differ = np.minimum.reduceat(hashes, starts) != np.maximum.reduceat(hashes, starts)
            ends = np.append(starts[1:], len(keys))
            for start, end in zip(starts[differ], ends[differ], strict=True):
                for a, b in _bucket_pairs(hashes[start:end], marks[start:end], edits):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns, strict=True)]
            changes = np.flatnonzero(columns[0][1:] != columns[0][:-1])
            cut = int(changes[-1]) + 1 if len(changes) else 0
            if cut:
                yield from run(*[c[:cut] for c in columns])
            rest = [c[cut:] for c in columns]
        if len(rest[0]):
            yield from run(*rest)

    dealt = _keys(docs, edits, text).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(pair, "a long, b long").distinct()


def line_links(docs: DataFrame, edits: int = MAX_EDITS, text: str = "text") -> DataFrame:
    """Pairs ``a``, ``b`` of hashes of different lines at most ``edits`` edits apart."""
    pairs = stored(candidate_pairs(docs, edits, text), "line-pairs")
    wanted = stored(
        pairs.select(F.col("a").alias("hash")).unionByName(pairs.select(F.col("b").alias("hash"))).distinct(), "line-wanted"
    )
    met = small_or_salted(_lines(docs, text).select("hash", "line"), wanted.withColumn("_wanted", F.lit(True)), "hash")
    texts = stored(met.filter("_wanted").groupBy("hash").agg(F.min("line").alias("line")), "line-texts")
    both = pairs.join(texts.select(F.col("hash").alias("a"), F.col("line").alias("line_a")), "a").join(
        texts.select(F.col("hash").alias("b"), F.col("line").alias("line_b")), "b"
    )
    both = both.select("a", "b", "line_a", "line_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            order = sorted(range(len(lines)), key=lambda i: len(lines[i][0]))
            near: list[int] = []
            at = 0
            while at < len(order):
                # Lanes of nearly one length, and fewer of them where lines are long.
                size = max(1, min(PAIRS, (1 << 22) // (len(lines[order[at]][0]) + 64)))
                part = order[at : at + size]
                found = edit_distances([lines[i] for i in part], edits)
                near += [i for i, d in zip(part, found, strict=True) if d <= edits]
                at += size
            if near:
                yield batch.take(pa.array(near)).select(["a", "b"])

    return stored(both.mapInArrow(check, "a long, b long"), "line-links")


def line_classes(docs: DataFrame, edits: int = MAX_EDITS, text: str = "text") -> DataFrame:
    """The class of every line of every document.

    Lines are what the line ends of a text part. Two lines are linked if they are equal, or
    if both have ``MIN_CHARS`` characters or more and are at most ``edits`` insertions,
    deletions and substitutions apart; a class is what links connect, and its first line (by
    doc_id, then place) is kept.

    A row per line: doc_id, line_no (from 0), class_doc_id and class_line_no (the first line
    of the class), n_links (the number of different other lines it is linked with) and kept.
    A line of nothing but white space is a class of its own. A null text has no lines, an
    empty one has one. Null ids come after all others. Lines are identified by a 64-bit hash.
    Rows of equal doc_id and text are one document, of which both are kept.
    """
    lines = _lines(docs, text)
    blank = ~F.col("line").rlike(WORD)
    occurring = stored(lines.select("doc_id", "line_no", "hash", blank.alias("blank")), "line-places")
    links = line_links(docs, edits, text)
    labels = components(links)
    degrees = (
        links.select(F.col("a").alias("hash"))
        .unionByName(links.select(F.col("b").alias("hash")))
        .groupBy("hash")
        .agg(F.count("*").alias("n_links"))
    )
    # Ids that are null must not be the smallest.
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "line_no")
    firsts = occurring.filter("not blank").groupBy("hash").agg(F.min(place).alias("first"))
    known = firsts.join(labels.withColumnRenamed("uid", "hash"), "hash", "left").join(degrees, "hash", "left")
    known = stored(
        known.select("hash", "first", "label", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")), "line-firsts"
    )
    least = known.filter("label is not null").groupBy("label").agg(F.min("first").alias("class_first"))
    classes = known.join(least, "label", "left").select("hash", F.coalesce("class_first", "first").alias("class"), "n_links")
    placed = occurring.join(classes, "hash", "left")
    own = F.col("blank") | F.col("class").isNull()
    first_id = F.when(own, F.col("doc_id")).otherwise(F.col("class.doc_id"))
    first_no = F.when(own, F.col("line_no")).otherwise(F.col("class.line_no"))
    return placed.select(
        "doc_id",
        "line_no",
        first_id.alias("class_doc_id"),
        first_no.alias("class_line_no"),
        F.when(own, F.lit(0).cast("bigint")).otherwise(F.col("n_links")).alias("n_links"),
        (F.col("doc_id").eqNullSafe(first_id) & (F.col("line_no") == first_no)).alias("kept"),
    )


def dedup_lines(docs: DataFrame, edits: int = MAX_EDITS, text: str = "text") -> DataFrame:
    """Documents without the lines that repeat an earlier line, with the columns they came with.

    A document of which nothing but white space is left goes, if it had more before. Texts of
    null ids stay as they are.
    """
    dropped = (
        line_classes(docs.filter("doc_id is not null"), edits, text)
        .filter("not kept")
        .groupBy("doc_id")
        .agg(F.collect_set("line_no").alias("_dropped"))
    )
    met = small_or_salted(docs, stored(dropped, "line-dropped"), "doc_id")

    @F.pandas_udf("string")
    def rest(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        out = []
        for value, gone in zip(texts, numbers, strict=True):
            if value is None or gone is None or not len(gone):
                out.append(value)
            else:
                gone = set(np.asarray(gone).tolist())
                out.append("\n".join(line for i, line in enumerate(value.split("\n")) if i not in gone))
        return pd.Series(out, dtype=object)

    left = met.withColumn("_rest", F.when(F.col("_dropped").isNull(), F.col(text)).otherwise(rest(F.col(text), F.col("_dropped"))))
    left = left.filter(F.col("_dropped").isNull() | F.col("_rest").rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*[F.col("_rest").alias(c) if c == text else F.col(quoted(c)) for c in docs.columns])
