"""Periodic runs of words: stretches that repeat themselves with a smallest period.

The words of a text span a matrix of equal pairs; a stretch of period q is a stretch of
matches on the diagonal of lag q. Words are read in order. Each word's earlier occurrences
raise the match lengths of the lags they stand at; a lag that no occurrence raises any more
ends, and emits its run at once if it was long enough.

The matrix is kept sparse without losing a run. A run of period q is at least three periods
long, so its last 2q words match q words earlier, in a context of ``span`` words for any
``span`` of at least q and less than 2q. Only occurrences in an equal context of ``span``
words, the power of two from q on, can be part of such a diagonal, and of these only the
nearest: were a nearer one equal too, the context would have a smaller period. So every word
raises one lag per power of two at most, whatever the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentgrade.llm.common import WORD, quoted

MIN_LENGTH = 24
MIN_PERIODS = 3
# Texts of a batch are looked at in parts of about so many characters.
PART_CHARS = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15

Run = tuple[int, int, int]


def shortest_match(min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> int:
    """The least number of matching words in a row that any run has on its diagonal."""
    return min(max(min_length - q, (min_periods - 1) * q) for q in range(1, min_length + 1))


def _numbered(words: Sequence[str]) -> np.ndarray:
    """Equal words get equal numbers."""
    numbers: dict[str, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))


def _nearest(context: np.ndarray, span: int) -> np.ndarray:
    """How far back the nearest earlier end of an equal context lies, 0 where there is none."""
    lag = np.zeros(len(context), dtype=np.int64)
    order = np.argsort(context[span - 1 :], kind="stable") + span - 1
    same = context[order[1:]] == context[order[:-1]]
    lag[order[1:][same]] = (order[1:] - order[:-1])[same]
    return lag


def occurrences(numbers: np.ndarray, min_periods: int = MIN_PERIODS) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each span, the positions whose context occurred before at a lag of that span, and the lags."""
    found = []
    context, span = numbers, 1
    while (span // 2 + 1) * min_periods <= len(numbers):
        lag = _nearest(context, span)
        at = np.flatnonzero((lag > span // 2) & (lag <= span))
        if len(at):
            found.append((span, at, lag[at]))
        if not lag.any():
            break  # no context of this span is repeated, so no longer one is
        if 2 * span > len(numbers):
            break
        pairs = np.full(len(context), -1, dtype=np.int64)
        end = np.arange(2 * span - 1, len(context))
        pairs[end] = np.unique(context[end - span] * np.int64(len(context) + 1) + context[end], return_inverse=True)[1]
        context, span = pairs, 2 * span
    return found


def runs_of(words: Sequence[str] | np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[Run]:
    """All runs as (start, length, period), by start and period.

    A run is a stretch with smallest period q, at least ``min_length`` words and
    ``min_periods`` periods long, that no neighbouring word extends. ``min_periods`` is three or more.
    """
    if min_periods < 3:
        raise ValueError("runs have three periods or more")
    numbers = words if isinstance(words, np.ndarray) else _numbered(words)
    levels = occurrences(numbers, min_periods)
    if not levels:
        return []
    at = np.concatenate([a for _, a, _ in levels])
    lags = np.concatenate([lag for _, _, lag in levels])
    spans = np.concatenate([np.full(len(a), span) for span, a, _ in levels])
    order = np.argsort(at, kind="stable")
    runs: list[Run] = []
    active: dict[int, int] = {}  # lag -> words matched so far
    before = -1

    def end(lag: int, matched: int, last: int) -> None:
        length = matched + lag
        if length >= min_length and length >= min_periods * lag:
            runs.append((last - length + 1, length, lag))

    raised: dict[int, int] = {}
    for i, lag, span in zip(at[order].tolist(), lags[order].tolist(), spans[order].tolist(), strict=True):
        if i != before:
            for old, matched in active.items():
                if old not in raised:
                    end(old, matched, before - 1)
            active, raised = raised, {}
            if i != before + 1:
                for old, matched in active.items():
                    end(old, matched, before)
                active = {}
            before = i
        # The first time, all of the context matches; from then on one word more each time.
        raised[lag] = active.get(lag, span - 1) + 1
    for old, matched in active.items():
        if old not in raised:
            end(old, matched, before - 1)
    for old, matched in raised.items():
        end(old, matched, before)
    return sorted(runs, key=lambda run: (run[0], run[2]))


def may_have_runs(hashes: np.ndarray, border: np.ndarray, span: int) -> np.ndarray:
    """Which of the texts that lie one after another repeat a context of ``span`` words.

    ``border`` holds where each text begins, and the end. Equal hashes count as equal words,
    so a text can be named without reason, but none with a run is left out.
    """
    found = np.zeros(len(border) - 1, dtype=bool)
    if len(hashes) < span:
        return found
    context = hashes[span - 1 :].astype(np.uint64)
    for back in range(1, span):
        context = context * np.uint64(_MULTIPLIER) + hashes[span - 1 - back : len(hashes) - back]
    text = np.repeat(np.arange(len(found)), np.diff(border))
    whole = np.flatnonzero(text[span - 1 :] == text[: len(text) - span + 1])
    inside, owner = context[whole], text[whole + span - 1]
    order = np.argsort(inside, kind="stable")
    again = (inside[order[1:]] == inside[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    found[owner[order[1:][again]]] = True
    return found


def collapsed(words: Sequence[str], runs: list[Run]) -> Sequence[str]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    return [words[i] for i in kept.tolist()]


def strongest(runs: list[Run]) -> Run | None:
    """The run of greatest length by period; of equal ones the earliest, then of smallest period."""
    return min(runs, key=lambda run: (-Fraction(run[1], run[2]), run[0], run[2]), default=None)


def repeat_tail(words: list[str], seed: int) -> list[str]:
    """Words of which the tail repeats its beginning; where and how often follows from the seed."""
    n = len(words)
    if not n:
        return words
    a = seed % n
    p = 1 + (n - a) // (3 + seed % 8)
    whole, rest = divmod(n - a, p)
    tail = words[a : a + p]
    return words[:a] + tail * whole + tail[:rest]


_SCHEMA = (
    "n_words long, n_runs long, runs array<struct<start:long,length:long,period:long>>, "
    "best struct<start:long,length:long,period:long,exponent_milli:long>, runs_sha256 string, {text}collapsed_sha256 string"
)
_STRUCT = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
_BEST = pa.struct([(name, pa.int64()) for name in ("start", "length", "period", "exponent_milli")])


def find_runs(
    documents: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    tail_seed: Column | None = None,
    min_length: int = MIN_LENGTH,
    min_periods: int = MIN_PERIODS,
    with_text: bool = True,
) -> DataFrame:
    """The periodic runs of each whole text, and the text without their repetitions.

    Returns one row for each row, in one pass without a shuffle: the key, ``n_words``, ``n_runs``, all ``runs`` by
    start and period, the ``best`` of them by length over period (null if there is none), ``collapsed`` (the words that no run
    contains after its first period, joined by one blank; left out unless ``with_text``), and the SHA-256 in lower-case
    hexadecimal of the runs as lines ``start,length,period`` and of the collapsed text.

    A null or empty text, or one of white space, has no words and no run. Words are compared
    as they are. ``tail_seed``, a number or null, asks for a text whose tail repeats before
    runs are searched (see ``repeat_tail``). Rows with equal or null keys are rows like
    others; further columns are left out. Memory follows the longest text.
    """
    kind = documents.schema[key].dataType.simpleString()
    words_of = re.compile(WORD).findall
    span = shortest_match(min_length, min_periods)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                done = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, done + PART_CHARS, side="right")))
                yield part(batch.slice(start, stop - start))
                start = stop

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text_, seed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = words_of(text_ or "")
            texts.append(words if seed is None else repeat_tail(words, seed))
        border = np.concatenate([[0], np.cumsum([len(words) for words in texts])])
        hashes = np.fromiter((hash(w) for words in texts for w in words), dtype=np.int64, count=int(border[-1]))
        may = may_have_runs(hashes.view(np.uint64), border, span)
        found = [runs_of(words, min_length, min_periods) if maybe else [] for words, maybe in zip(texts, may, strict=True)]
        kept = [" ".join(collapsed(words, runs)) for words, runs in zip(texts, found, strict=True)]
        best = [strongest(runs) for runs in found]
        lines = ["".join(f"{s},{n},{p}\n" for s, n, p in runs) for runs in found]
        names = ("start", "length", "period")
        columns = {
            key: batch.column(0),
            "n_words": pa.array([len(words) for words in texts], pa.int64()),
            "n_runs": pa.array([len(runs) for runs in found], pa.int64()),
            "runs": pa.array([[dict(zip(names, run, strict=True)) for run in runs] for runs in found], _STRUCT),
            "best": pa.array([b and {**dict(zip(names, b, strict=True)), "exponent_milli": 1000 * b[1] // b[2]} for b in best], _BEST),
            "runs_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lines], pa.string()),
            "collapsed": pa.array(kept, pa.string()),
            "collapsed_sha256": pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in kept], pa.string()),
        }
        if not with_text:
            del columns["collapsed"]
        return pa.RecordBatch.from_pydict(columns)

    seed = F.lit(None).cast("bigint") if tail_seed is None else tail_seed.cast("bigint")
    rows = documents.select(F.col(quoted(key)), F.col(quoted(text)).cast("string").alias("_text"), seed.alias("_seed"))
    schema = _SCHEMA.format(text="collapsed string, " if with_text else "")
    return rows.mapInArrow(results, f"`{key}` {kind}, {schema}")


def tail_seed_of(key: Column) -> Column:
    """For one in ten ids a seed from the CRC-32 of the decimal id, null for the others and for a null id."""
    crc = F.crc32(key.cast("string").cast("binary"))
    return F.when(crc % 10 == 0, F.floor(crc / 10).cast("bigint"))
