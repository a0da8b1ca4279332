"""A quality score from two compression dictionaries.

One zstandard dictionary is built from good and one from bad labelled texts. A text is
compressed with each; the difference of the two sizes, in proportion to the length and to
their sum, becomes a probability by a logistic calibration on labelled texts that were not
used for the dictionaries.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentgrade.llm.common import columns_of, quoted
from contentgrade.llm.mixing import seeded_hash

DICTIONARY_BYTES = 65536
LEVEL = 3
# What short texts are drawn towards: bytes added to every length.
SHRINK = 64
# Bytes at which a text counts half as much as a very long one.
EVIDENCE = 500
# Bounds of the labelled sample: texts of each label, and bytes of all texts of a label.
SAMPLE_GOOD = 8000
SAMPLE_BAD = 4000
SAMPLE_BYTES = 40_000_000
# Texts of each label that a dictionary is made from, at most.
DICTIONARY_TEXTS = 1500
FEATURES = 8


def held_out(doc_id) -> bool:
    """Rows from whose labels nothing is learned."""
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def _dictionary(texts: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """A trained dictionary, or the texts themselves when there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, texts)
    except zstandard.ZstdError:
        content = b"\n".join(texts)[-size:] or b"\n" * 8
        return zstandard.ZstdCompressionDict(content.rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


@dataclass
class QualityModel:
    """Two dictionaries and a calibration; a few hundred kilobytes."""

    good: bytes
    bad: bytes
    raw: tuple[bool, bool] = (False, False)
    low: list[float] = field(default_factory=lambda: [-np.inf] * FEATURES)
    high: list[float] = field(default_factory=lambda: [np.inf] * FEATURES)
    mean: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    scale: list[float] = field(default_factory=lambda: [1.0] * FEATURES)
    weights: list[float] = field(default_factory=lambda: [0.0] * (FEATURES + 1))

    def compressors(self) -> list[tuple[zstandard.ZstdCompressor, int]]:
        """The two compressors with the size each gives to an empty text."""
        found = []
        for content, raw in zip((self.good, self.bad), self.raw, strict=True):
            kind = zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT
            compressor = zstandard.ZstdCompressor(
                level=LEVEL,
                dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind),
                write_content_size=False,
                write_checksum=False,
                write_dict_id=False,
            )
            found.append((compressor, len(compressor.compress(b""))))
        return found

    def features(self, texts: list[bytes]) -> np.ndarray:
        (good, good0), (bad, bad0) = self.compressors()
        g = np.array([max(len(good.compress(t)) - good0, 0) for t in texts], dtype=float)
        b = np.array([max(len(bad.compress(t)) - bad0, 0) for t in texts], dtype=float)
        n = np.array([len(t) for t in texts], dtype=float) + SHRINK
        by_length = (b - g) / n
        by_size = (b - g) / (b + g + SHRINK)
        rest = (b + g) / (2 * n)
        size = np.log(n)
        return np.stack(
            [by_length, by_size, rest, size, by_length**2, rest**2, by_length * rest, by_length * size], axis=1
        )

    def standard(self, texts: list[bytes]) -> np.ndarray:
        """Features in standard units; of short texts, which prove little, they are smaller."""
        x = np.clip(self.features(texts), self.low, self.high)
        n = np.array([len(t) for t in texts], dtype=float)[:, None]
        return (x - np.array(self.mean)) / np.array(self.scale) * (n / (n + EVIDENCE))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = self.standard(texts)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Penalised maximum likelihood by Newton steps, halved until they improve."""
    a = np.hstack([np.ones((len(x), 1)), x])
    ridge = np.full(a.shape[1], penalty * len(x))
    ridge[0] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(ridge * w * w))

    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        gradient = a.T @ (p - y) + ridge * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        size, before = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > before:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def train(
    texts: list[bytes],
    labels: list[int],
    odds: float | None = None,
    dictionary_bytes: int = DICTIONARY_BYTES,
    dictionary_texts: int = DICTIONARY_TEXTS,
) -> QualityModel:
    """Fit on texts in the given order: the first half of each label makes the dictionaries.

    That is at most ``dictionary_texts`` of a label; the rest serves the calibration.

    ``odds`` are those of good to bad among all labels, if the sample has others.
    """
    good = [t for t, y in zip(texts, labels, strict=True) if y == 1]
    bad = [t for t, y in zip(texts, labels, strict=True) if y == 0]
    cut = (min((len(good) + 1) // 2, dictionary_texts), min((len(bad) + 1) // 2, dictionary_texts))
    made = [_dictionary(part[:n], dictionary_bytes) for part, n in zip((good, bad), cut, strict=True)]
    model = QualityModel(
        made[0].as_bytes(), made[1].as_bytes(), tuple(d.dict_id() == 0 for d in made)  # raw content has no id
    )
    rest_good, rest_bad = good[cut[0] :] or good, bad[cut[1] :] or bad
    y = np.array([1.0] * len(rest_good) + [0.0] * len(rest_bad))
    if not len(y):
        return model
    if not rest_good or not rest_bad:
        model.weights[0] = float(np.log((len(rest_good) + 1) / (len(rest_bad) + 1)))
        return model
    x = model.features(rest_good + rest_bad)
    model.low, model.high = (np.quantile(x, q, axis=0).tolist() for q in (0.002, 0.998))
    x = np.clip(x, model.low, model.high)
    model.mean, model.scale = x.mean(axis=0).tolist(), (x.std(axis=0) + 1e-9).tolist()
    model.weights = _logistic(model.standard(rest_good + rest_bad), y, penalty=1e-4).tolist()
    if odds is not None:
        model.weights[0] += float(np.log(odds) - np.log(len(rest_good) / len(rest_bad)))
    return model


def labelled_sample(
    docs: DataFrame, labels: DataFrame, text: str = "text"
) -> tuple[list[bytes], list[int], float | None]:
    """A bounded sample of labelled texts, the same in every run.

    At most ``SAMPLE_GOOD`` and ``SAMPLE_BAD`` documents of the two labels, those of the
    smallest seeded hashes, and of these as many as fit in ``SAMPLE_BYTES`` a label. Rows
    whose id has a crc32 of remainder 1 by 3, a null id, a null text or contradictory labels
    teach nothing. The odds of good to bad among all other labels come with the sample.
    """
    doc_id = F.col("doc_id")
    known = (
        labels.filter(doc_id.isNotNull() & F.col("quality").isin(0, 1))
        .filter(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1)
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_y"), F.max("quality").alias("_other"))
        .filter("_y = _other")
        .select("doc_id", "_y", seeded_hash(doc_id, "quality:").alias("_h"))
    )
    ones, rows = known.agg(F.coalesce(F.sum("_y"), F.lit(0)), F.count("*")).first()
    odds = ones / (rows - ones) if 0 < ones < rows else None
    # The labels may name documents that are not there, so the sample is twice as large as needed.
    parts = [
        known.filter(F.col("_y") == y).orderBy("_h", "doc_id").limit(2 * n)
        for y, n in ((1, SAMPLE_GOOD), (0, SAMPLE_BAD))
    ]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    found = docs.select("doc_id", F.col(text).alias("_text")).filter("_text is not null").join(chosen, "doc_id")
    sizes = found.select("_y", "_h", "doc_id", F.octet_length("_text").alias("_n")).collect()
    used, keep, seen = {0: 0, 1: 0}, {0: {}, 1: {}}, set()
    for y, h, key, n in sorted(sizes):
        if key not in seen and len(keep[y]) < (SAMPLE_GOOD if y else SAMPLE_BAD) and used[y] + n <= SAMPLE_BYTES:
            seen.add(key)
            used[y] += n
            keep[y][key] = h
    ids = [(key, y, h) for y in (0, 1) for key, h in keep[y].items()]
    if not ids:
        return [], [], odds
    table = docs.sparkSession.createDataFrame(ids, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _y int, _h long")
    rows = (
        docs.select("doc_id", F.col(text).alias("_text"))
        .filter("_text is not null")
        .join(F.broadcast(table), "doc_id")
        .groupBy("doc_id", "_y", "_h")
        .agg(F.min("_text").alias("_text"))
        .collect()
    )
    rows.sort(key=lambda r: (r["_h"], str(r["doc_id"])))
    return [r["_text"].encode() for r in rows], [r["_y"] for r in rows], odds


def fit_quality(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit the model on the driver from the bounded labelled sample."""
    return train(*labelled_sample(docs, labels))


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", score: str = "score") -> DataFrame:
    """Add the score of every whole text; a narrow step, a batch of rows at a time.

    A null text is scored as an empty one. A column named like the score is replaced; all
    others stay, whatever they are called.
    """
    kept = [c for c in docs.columns if c != score]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(shared.value.scores([("" if t is None else t).encode() for t in part]), dtype=float)

    return docs.select(*[F.col(quoted(c)) for c in kept], scored(F.col(text)).alias(score))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score reaches the threshold, with the columns they came with."""
    scored = score_quality(docs, fit_quality(docs, labels), score="_quality_score")
    return scored.filter(F.col("_quality_score") >= threshold).select(*columns_of(docs))
