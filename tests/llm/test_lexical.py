"""Lexical search against brute force in whole numbers."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from contentgrade.llm import lexical
from contentgrade.llm.queries import QUERIES

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERMS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    count, total = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(t for _, tf, _ in held for t in tf)
    out = []
    for item_id, text in set(items):
        scored = []
        for doc_id, tf, n in held:
            score = 0
            for t in terms(text):
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                    m = 100 - 75 + (75 * n * count) // total
                    score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0 and doc_id is not None:
                scored.append((-score, doc_id))
        out += [(item_id, rank, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus():
    r = random.Random(8)
    words = [f"w{k}" for k in range(60)] + ["É", "é", "naïve", "X1", "x1"]
    docs = [(i, r.choice([" ", "-", ", "]).join(r.choices(words, k=r.randrange(0, 40)))) for i in range(300)]
    docs += [(400 + i, "same words here w1") for i in range(60)]
    docs += [(500, None), (501, ""), (502, "-- !!"), (None, "w1 w2 unheard"), (7, "w3 w3 w3"), (7, "w3 w3 w3"), (503, "w5 " * 30_000)]
    items = [(i, " ".join(r.choices(words, k=r.randrange(1, 12)))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "nowhere"), (33, "w1 " * 50), (33, "w1 " * 50), (34, "É"), (34, "é x1"), (None, "same words")]
    return docs, items


@pytest.mark.parametrize("settings", [{}, {"BLOCK_ITEMS": 14, "TILE_TERMS": 5, "TILE_DOCS": 16}])
def test_ranks_are_those_of_brute_force(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus()
    table = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, term string, `a.b` int").repartition(3)
    queries = spark.createDataFrame([(*i, "s") for i in items], "item_id long, text string, doc_id string")
    found = lexical.search_lexical(table, queries, k=10)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs, items, 10)
    assert lexical.search_lexical(table.limit(0), queries).count() == 0
    assert lexical.search_lexical(table, queries.limit(0)).count() == 0


def test_tiles_keep_sums_below_their_bound():
    r = np.random.default_rng(5)
    item, term = np.divmod(r.permutation(40 * 30)[:500], 30)
    count = r.integers(1, 2000, 500)
    weight = r.integers(0, 900, 30)
    exact = lexical.IMPACT * 20_000
    parts = lexical.tiles(item, term, count, weight, 40, 7, exact)
    whole = np.zeros((40, 30), dtype=np.int64)
    for part in parts:
        assert len(part.terms) <= 7
        assert (part.weights.sum(axis=1) * lexical.IMPACT <= exact).all()
        np.add.at(whole.T, part.terms, part.weights.T.astype(np.int64))
    expected = np.zeros((40, 30), dtype=np.int64)
    expected[item, term] = count * weight[term]
    assert (whole == expected).all()


def test_scores_beyond_float_stay_exact(spark, monkeypatch):
    docs = [(i, f"t{i} a b") for i in range(5)] + [(9, "a")]
    items = [(1, "t3 " * 700_000 + "a")]
    found = lexical.search_lexical(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = [tuple(r) for r in found.collect()]
    assert max(r[3] for r in rows) > 1 << 48
    count, total = 6, 16
    weight = {df: math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1))) for df in (1, 6)}
    impact = 1000000000 // (1000 + 8 * (25 + (75 * 3 * count) // total))
    assert sorted(rows)[0] == (1, 1, 3, 700_000 * weight[1] * impact + weight[6] * impact)


def test_registered_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    found = sorted((tuple(r) for r in QUERIES["op12_lexical"](spark, sf_dir).collect()), key=str)
    assert found == brute(docs, items, 10)
