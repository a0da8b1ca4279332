"""Periodic runs against brute force over all periods."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contentgrade.llm import runs
from contentgrade.llm.queries import QUERIES


def brute_runs(words, min_length=24, min_periods=3):
    found = []
    for q in range(1, len(words) // min_periods + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if j > i and length >= max(min_length, min_periods * q):
                stretch = words[start : start + length]
                if all(any(stretch[k] != stretch[k - p] for k in range(p, length)) for p in range(1, q)):
                    found.append((start, length, q))
            i = j + 1
    return sorted(found, key=lambda run: (run[0], run[2]))


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return (doc_id, len(found), *figures, *digests)


words_of_few = st.lists(st.sampled_from("ab"), max_size=90)
pieces = st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(1, 9)), max_size=7)


@settings(max_examples=300, deadline=None)
@given(words_of_few, pieces, st.sampled_from([(24, 3), (6, 3), (5, 4)]))
def test_runs_are_those_of_all_periods(plain, repeated, least):
    words = plain + [w for unit, times in repeated for w in unit * times]
    assert runs.runs_of(words, *least) == brute_runs(words, *least)


@pytest.mark.parametrize(
    "words",
    [["a"] * 60_000, [str(k) for k in range(20_000)] * 3, [f"{k % 7}" for k in range(60_000)], ["x", "y", "y"] * 20_000],
)
def test_long_repetitive_texts_take_linear_work(words):
    ((start, length, period),) = runs.runs_of(words)
    assert (start, length) == (0, len(words)) and words[period:] == words[:-period]


def test_texts_without_reason_are_left_out_only():
    r = random.Random(2)
    texts = [[str(r.randrange(50)) for _ in range(r.randrange(0, 60))] for _ in range(200)]
    texts += [["u", "v"] * r.randrange(1, 20) for _ in range(50)] + [[], ["w"]]
    numbers = runs._numbered([w for t in texts for w in t]).astype("uint64")
    border = [0]
    for t in texts:
        border.append(border[-1] + len(t))
    may = runs.may_have_runs(numbers, runs.np.array(border), runs.shortest_match())
    assert all(maybe or not brute_runs(t) for t, maybe in zip(texts, may, strict=True))
    assert 0 < may.sum() < len(texts)


def test_periods_below_three_are_refused():
    with pytest.raises(ValueError, match="three periods"):
        runs.runs_of(["a"] * 50, min_periods=2)


def corpus():
    r = random.Random(4)
    docs = []
    for i in range(400):
        words = [f"w{r.randrange(30)}" for _ in range(r.randrange(0, 80))]
        unit = [f"u{r.randrange(4)}" for _ in range(r.randrange(1, 12))]
        docs.append((i, " ".join(words + unit * r.randrange(0, 7) + words[:5])))
    docs += [(500, None), (501, ""), (502, " \t\n "), (503, "one"), (None, "b " * 30), (None, None), (0, "a b " * 40), (0, "a b " * 40)]
    return docs + [(504, "x " * 60_000), (505, "É é\u00a0é " * 12), (506, "line\rbreak\x0b\x0ctab\t" * 10)]


def test_query_rows_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(runs, "PART_CHARS", 5000)
    docs = corpus()
    table = spark.createDataFrame([(*d, "y", "z") for d in docs], "doc_id long, text string, `n_runs` string, `a.b` string")
    found = runs.find_runs(table.repartition(3), tail_seed=runs.tail_seed_of(F.col("doc_id")))
    rows = found.select("doc_id", "n_runs", "best.*", "runs_sha256", "collapsed_sha256").collect()
    short = [d for d in docs if len(d[1] or "") < 10_000]
    expected = sorted((brute_row(*d) for d in short), key=str)
    assert sorted((tuple(r) for r in rows if r["doc_id"] != 504), key=str) == expected
    (long,) = [r for r in rows if r["doc_id"] == 504]
    assert long["n_runs"] == 1 and long["period"] == 1
    assert found.filter("doc_id = 505").first()["collapsed"] == "É é\u00a0é"
    assert runs.find_runs(table.limit(0)).count() == 0


def test_registered_query_over_the_whole_table(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = [tuple(r) for r in QUERIES["op13_runs"](spark, sf_dir).collect()]
    assert len(rows) == len(docs)
    few = {i for i, text in docs.items() if len(text or "") < 6000}
    assert sorted(r for r in rows if r[0] in few) == sorted(brute_row(i, docs[i]) for i in few)
    assert any(r[1] for r in rows)
