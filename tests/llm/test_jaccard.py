"""The size-aware similarity join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentgrade.llm import jaccard
from contentgrade.llm.queries import QUERIES
from tests.llm.test_neardup_lines import brute_components, copies_of_copies, edited


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(11)
    docs = [(i, " ".join(f"w{r.randrange(4000)}" for _ in range(r.randrange(1, 160)))) for i in range(250)]
    base = [f"b{k}" for k in range(160)]
    docs += [(1000 + i, edited(r, base, i % 8)) for i in range(150)]
    docs += [(1400 + i, edited(r, base[:40], i % 2)) for i in range(60)]
    docs += [(1500 + i, " ".join(text)) for i, text in enumerate(copies_of_copies(r, 120, 300, "c"))]
    passage = " ".join(f"p{k}" for k in range(60))
    docs += [(2000 + i, passage + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(r.randrange(5, 60)))) for i in range(100)]
    docs += [(2200 + i, " ".join(f"s{r.randrange(3)}" for _ in range(r.randrange(4, 12)))) for i in range(150)]
    docs += [(3000 + i, "exactly the same text again and again") for i in range(50)]
    docs += [(4000, ""), (4001, None), (4002, " \t\n"), (4003, "one"), (4004, "ONE"), (4005, "two words"), (4006, "two  words")]
    docs += [(4007, "É é"), (4008, "é é"), (4009, "long " * 5000), (4010, "long " * 4000)]
    long = [f"l{r.randrange(10**6)}" for _ in range(20_000)]
    return docs + [(4011, " ".join(long)), (4012, " ".join(long[:17_000])), (4013, " ".join(long[:12_000]))]


@pytest.mark.parametrize("border", [None, -1, 40])
def test_components_are_those_of_all_pairs(spark, corpus, monkeypatch, border):
    if border is not None:
        monkeypatch.setattr(jaccard, "boundary", lambda costs: border)
        monkeypatch.setattr(jaccard, "HOT_GROUPS", 200)
        monkeypatch.setattr(jaccard, "KEYS", 1000)
        monkeypatch.setattr(jaccard, "BLOCK_ELEMENTS", 1000)
    some = [d for d in corpus if border is None or d[0] < 4011]
    docs = spark.createDataFrame(some, "doc_id long, text string").withColumn("sid", F.lit("x")).withColumn("a.b", F.lit(1))
    found = {r["doc_id"]: r for r in jaccard.similar_documents(docs.repartition(4)).collect()}
    sets, expected = brute_components(some, 5, 80)
    assert {i: r["n_shingles"] for i, r in found.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in found.items()} == expected


@pytest.mark.parametrize("words,percent", [(3, 60)])
def test_other_shingles_and_similarities(spark, corpus, words, percent):
    some = [d for d in corpus if d[0] < 2200 or 2999 < d[0] < 4009]
    found = jaccard.similar_documents(spark.createDataFrame(some, "doc_id long, text string"), words, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_components(some, words, percent)[1]


@pytest.mark.parametrize("wide,levels", [(1, 1), (3, 2)])
def test_pairs_left_meet_at_differences(spark, corpus, monkeypatch, wide, levels):
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    monkeypatch.setattr(jaccard, "WIDE", wide)
    monkeypatch.setattr(jaccard, "LEVELS", levels)
    some = [d for d in corpus if d[0] < 4011]
    for words, percent in ((5, 80), (3, 60)):
        docs = spark.createDataFrame(some, "doc_id long, text string").repartition(4)
        found = {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(docs, words, percent).collect()}
        assert found == brute_components(some, words, percent)[1]


def far_copies():
    """Copies of a text, each with a line somewhere that all have, so less than 80 % similar to nearly all others."""
    r = random.Random(3)
    line, base = [f"c{k}" for k in range(20)], [f"b{k}" for k in range(150)]
    docs = [(9000 + i, " ".join([*line, f"x{i}", "y"])) for i in range(60)]
    for i in range(500):
        at = r.randrange(130)
        docs.append((i, edited(r, base[:at] + line + base[at + 20 :], 1)))
    return docs


def test_far_copies_are_not_compared_in_all_pairs(spark, monkeypatch):
    docs, made, confirmed = far_copies(), [], jaccard.confirmed

    def counting(pairs, *rest):
        made.append(pairs.count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(jaccard, "confirmed", counting)
    found = jaccard.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["component_id"] for x in found} == brute_components(docs, 5, 80)[1]
    assert made[-1] < 20 * len(docs)


def copies_of_one_text(count):
    """Copies of a text with one to eight words of it changed anywhere."""
    r = random.Random(8)
    base = [f"b{k}" for k in range(150)]
    docs = []
    for i in range(count):
        words = list(base)
        for _ in range(r.choice((1, 1, 1, 2, 2, 3, 3, 4, 5, 6, 8))):
            words[r.randrange(150)] = r.choice((f"x{r.randrange(10**6)}", r.choice(base)))
        docs.append((i, " ".join(words)))
    return docs


def test_sets_meet_at_their_differences_to_the_middle_of_a_family(spark, monkeypatch):
    docs, compared, differences, confirmed = copies_of_one_text(900), [], [], jaccard.confirmed
    differ = jaccard._differences

    def counting(pairs, *rest):
        compared.append(pairs.count())
        return confirmed(pairs, *rest)

    def adding(*rest):
        found = differ(*rest)
        differences.append(found.agg(F.sum(F.size("elements"))).first()[0])
        return found

    monkeypatch.setattr(jaccard, "confirmed", counting)
    monkeypatch.setattr(jaccard, "_differences", adding)
    found = jaccard.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["component_id"] for x in found} == brute_components(docs, 5, 80)[1]
    assert differences and sum(differences) < 15 * len(docs)
    assert compared[-1] < 2 * len(docs)


def test_missing_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    near = text.replace("w59", "x")
    rows = [(7, text), (7, text), (7, "another text of more than five words"), (9, near), (None, text), (None, "alone and without an id here"), (3, None)]
    found = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in found), key=str) == sorted(
        [(7, 56, 7), (7, 56, 7), (7, 3, 7), (9, 56, 7), (None, 56, 7), (None, 2, None), (3, 0, 3)], key=str
    )


def test_nothing_to_join(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert jaccard.similar_documents(docs.limit(0)).count() == 0
    assert sorted(tuple(r) for r in jaccard.similar_documents(docs).collect()) == [(1, 1, 1), (2, 0, 2)]
    with pytest.raises(ValueError, match="one half"):
        jaccard.similar_documents(docs, similarity_percent=50)


def test_boundary_is_where_both_costs_are_least():
    r = np.random.default_rng(1)
    for _ in range(50):
        costs = [(n, int(a), int(b)) for n, a, b in zip(range(0, 40, 4), r.integers(0, 50, 10), r.integers(0, 50, 10), strict=True)]
        sums = {x: sum(a if n <= x else b for n, a, b in costs) for x in [-1, *(n for n, _, _ in costs)]}
        assert sums[jaccard.boundary(list(reversed(costs)))] == min(sums.values())


def test_required_share_of_samples_holds_for_similar_sets():
    r = np.random.default_rng(2)
    need = jaccard.required(80)
    for both, a, b in ((800, 100, 100), (800, 200, 0), (160, 20, 20)):
        for _ in range(200):
            hashes = r.integers(0, 1 << 62, both + a + b)
            one = np.sort(hashes[: both + a])[: jaccard.SAMPLE]
            two = np.sort(np.concatenate([hashes[:both], hashes[both + a :]]))[: jaccard.SAMPLE]
            assert len(np.intersect1d(one, two)) >= need


def test_registered_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = {r["doc_id"]: r["component_id"] for r in QUERIES["op11_jaccard"](spark, sf_dir).collect()}
    assert found == brute_components(docs, 5, 80)[1]
