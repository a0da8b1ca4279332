"""Near-duplicates, components and line classes against brute force."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contentgrade.llm import linededup, neardup
from contentgrade.llm.components import components
from contentgrade.llm.queries import QUERIES


def shingles(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return frozenset()
    k = min(n, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


class Groups:
    def __init__(self, keys):
        self.parent = {k: k for k in keys}

    def root(self, k):
        while self.parent[k] != k:
            k = self.parent[k]
        return k

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def brute_components(docs, n, percent):
    sets = {i: shingles(t, n) for i, t in docs}
    groups, ids = Groups(sets), list(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                groups.join(a, b)
    return sets, {i: groups.root(i) for i in ids}


def edited(random_, words, n):
    words = list(words)
    for _ in range(n):
        words[random_.randrange(len(words))] = f"new{random_.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    docs = [(i, " ".join(f"w{r.randrange(4000)}" for _ in range(r.randrange(3, 120)))) for i in range(300)]
    base = [f"b{k}" for k in range(200)]
    docs += [(1000 + i, edited(r, base, i % 9)) for i in range(120)]
    passage = " ".join(f"p{k}" for k in range(60))
    docs += [(2000 + i, passage + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(60))) for i in range(80)]
    docs += [(3000 + i, "exactly the same text again and again") for i in range(50)]
    docs += [(4000, ""), (4001, None), (4002, " \t\n"), (4003, "one"), (4004, "ONE"), (4005, "two words"), (4006, "two  words")]
    docs += [(4007, "É é"), (4008, "é é"), (4009, "long " * 5000)]
    return docs


@pytest.mark.parametrize("leaf", [512, 16])
@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_components_are_those_of_all_pairs(spark, corpus, monkeypatch, n, percent, leaf):
    monkeypatch.setattr(neardup, "LEAF", leaf)
    docs = spark.createDataFrame(corpus, "doc_id long, text string").withColumn("uid", F.lit("other")).repartition(4)
    found = {r["doc_id"]: r for r in neardup.near_duplicates(docs, n, percent).collect()}
    sets, expected = brute_components(corpus, n, percent)
    assert len(found) == len(corpus)
    for i, members in sets.items():
        assert found[i]["n_shingles"] == len(members)
        assert found[i]["kept"] == (found[i]["component_id"] == i)
    wrong = [i for i in expected if found[i]["component_id"] != expected[i]]
    assert len(wrong) == 0


def copies_of_copies(r, n, words, tag):
    """Each text is a copy of an earlier one, with a stretch of it replaced."""
    texts = [[f"{tag}{k}" for k in range(words)]]
    while len(texts) < n:
        text = list(r.choice(texts))
        at, long = r.randrange(words), r.randrange(1, 12)
        text[at : at + long] = [f"n{r.randrange(10**7)}" for _ in text[at : at + long]]
        texts.append(text)
    return [" ".join(t) for t in texts]


def test_copies_of_copies_pass_large_levels(spark, monkeypatch):
    n, percent = 3, 85
    monkeypatch.setattr(neardup, "LEAF", 32)
    r = random.Random(11)
    docs = list(enumerate(copies_of_copies(r, 700, 150, "g")))
    r.shuffle(docs)
    levels = []
    crossed = neardup._crossed
    monkeypatch.setattr(neardup, "_crossed", lambda *args: levels.append(args) or crossed(*args))
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(rows, n, percent).collect()}
    _, expected = brute_components(docs, n, percent)
    assert len(levels) >= 3
    assert found == expected


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, None), (None, "x y z")]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, ((r["doc_id"], r["component_id"]) for r in found))) == sorted(
        map(str, [(None, 3), (3, 3), (3, 3), (None, None), (None, None)])
    )
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).collect() == []


@given(st.lists(st.text(alphabet="aB é\t\n\x0b x", max_size=12), max_size=6), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_shingle_sets(parts, n):
    text = " ".join(parts)
    assert len(neardup.shingle_set(text, n)) == len(shingles(text, n))


def test_equal_words_hash_equally():
    a = neardup.word_hashes(b"one two one " + b"y" * 70_000 + b" two")
    assert a[0] == a[2] and a[1] == a[4] and len(set(a.tolist())) == 3


def test_intersections():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 500, 200).astype(np.uint64)) for _ in range(9)]
    expected = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    sets = [s * np.uint64(0x9E3779B97F4A7C15) for s in sets]
    sets = [np.sort(s) for s in sets]
    for columns, held in ((7, 1 << 21), (8192, 1 << 21), (8192, 100)):
        found = neardup.intersections(sets, columns, held)
        off = ~np.eye(9, dtype=bool)
        assert (found[off] == np.array(expected)[off]).all()


def test_components_of_paths_stars_and_loops(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 300)] + [(500, 501), (501, 500), (700, 700)]
    edges += [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(220)] + [(-5, 3)]
    r.shuffle(edges)
    groups = Groups({v for e in edges for v in e})
    for a, b in edges:
        groups.join(a, b)
    found = {x["uid"]: x["label"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert found == {v: groups.root(v) for v in linked}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


strings = st.text(alphabet="abé😀", max_size=24)


@given(st.lists(st.tuples(strings, strings), min_size=1, max_size=8), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_edit_distances(pairs, edits):
    assert linededup.edit_distances(pairs, edits).tolist() == [min(levenshtein(a, b), edits + 1) for a, b in pairs]


@given(strings, st.lists(st.tuples(st.integers(0, 30), st.sampled_from("abx")), max_size=2), st.integers(0, 2))
@settings(max_examples=500, deadline=None)
def test_near_lines_share_a_key(line, changes, kind):
    line = "some line to begin " + line
    other = list(line)
    for at, sign in changes:
        at = min(at, len(other) - 1)
        other[at : at + (kind != 1)] = sign if kind != 2 else ""
    other = "".join(other)
    if min(len(line), len(other)) < linededup.MIN_CHARS:
        return
    long, short = sorted((line, other), key=len, reverse=True)
    held = {k for k, role in linededup.keys_of(short, 2) if role == linededup.BOTH}
    assert held & {k for k, _ in linededup.keys_of(long, 2)}
    assert linededup.near_parities(*(np.array([linededup.parities(x)]) for x in (line, other)), 2).all()


def brute_lines(docs):
    places = {}
    for i, text in docs:
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            if line.strip(" \t\n\r\x0b\x0c"):
                places.setdefault(line, []).append((i, k))
    groups, degree = Groups({min(p) for p in places.values()}), {}
    lines = [x for x in places if len(x) >= linededup.MIN_CHARS]
    for k, a in enumerate(lines):
        for b in lines[:k]:
            if abs(len(a) - len(b)) <= 2 and levenshtein(a, b) <= 2:
                groups.join(min(places[a]), min(places[b]))
                degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    return {o: (groups.root(min(p)), degree.get(x, 0)) for x, p in places.items() for o in p}


@pytest.fixture(scope="module")
def lined():
    r = random.Random(8)
    lines = ["".join(r.choice("abcdefgh ") for _ in range(r.randrange(17, 50))) for _ in range(60)]
    def change(line):
        line = list(line)
        for _ in range(r.randrange(4)):
            line[r.randrange(len(line))] = r.choice("xyz")
        return "".join(line)
    docs = [(i, "\n".join(change(r.choice(lines)) for _ in range(r.randrange(1, 6)))) for i in range(60)]
    docs += [(100, ""), (101, None), (102, "\n \n"), (103, "short"), (104, "short\nshore"), (105, "line end\r\nthe common line of all\n")]
    docs += [(200 + i, "the common line of all\nand one of its own %d" % (i * 7919)) for i in range(30)]
    docs += [(300, "z" * 30_000), (301, "z" * 29_999 + "y")]
    return docs


def test_line_classes_are_those_of_all_pairs(spark, lined):
    docs = spark.createDataFrame(lined, "doc_id long, text string").withColumn("line", F.lit(1)).repartition(3)
    found = linededup.line_classes(docs).collect()
    expected = brute_lines([d for d in lined if d[0] < 300])
    expected |= {(300, 0): ((300, 0), 1), (301, 0): ((300, 0), 1)}
    assert len(found) == sum(len(t.split("\n")) for _, t in lined if t is not None)
    for r in found:
        own = (r["doc_id"], r["line_no"])
        first, links = expected.get(own, (own, 0))
        assert ((r["class_doc_id"], r["class_line_no"]), r["n_links"], r["kept"]) == (first, links, first == own)


def test_dedup_lines(spark, lined):
    rows = [(i, t, "en") for i, t in lined] + [(None, "the common line of all", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    left = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    expected = brute_lines([d for d in lined if d[0] < 300])
    for i, text in lined:
        if i >= 300 or text is None:
            continue
        kept = [x for k, x in enumerate(text.split("\n")) if expected.get((i, k), ((i, k), 0))[0] == (i, k)]
        if any(x.strip() for x in kept) or len(kept) == len(text.split("\n")):
            assert left[i]["text"] == "\n".join(kept)
        else:
            assert i not in left
    assert left[101]["text"] is None and left[None]["text"] and 301 not in left
    assert linededup.dedup_lines(docs).columns == docs.columns
    assert linededup.dedup_lines(docs.limit(0)).collect() == []


def test_queries(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = {r["doc_id"]: r["component_id"] for r in QUERIES["op6_neardup"](spark, sf_dir).collect()}
    assert found == brute_components(docs, 3, 85)[1]
    lines = QUERIES["op4_linededup"](spark, sf_dir)
    assert lines.count() == sum(len(t.split("\n")) for _, t in docs)
