"""Text metrics against Python's own regular expressions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contentgrade.functions import text as X
from contentgrade.operators.metrics import extract_metrics

NUMBER = re.compile(r"\b\d+(?:[.,]\d+)?\b")
# The citation patterns of the scoring rules.
CITED = (
    re.compile(r"\b(?:ivass|eiopa|isvap|solvency\s*ii|european insurance)\b", re.I),
    re.compile(r"\bregolament[oi]|circolare|normativa\b", re.I),
)


def expected(text, html=""):
    low = text.lower()
    return {
        "word_count": len(re.findall(r"\w+", low)),
        "actuarial_terms": {t: low.count(t) for t in X.DOMAIN_TERMS if t in low},
        "numeric_tokens": len(NUMBER.findall(text)),
        "has_formula": bool(
            "\\begin{equation}" in text or re.search(r"\\\[.*?\\\]", text, re.S) or re.search("[=≠≤≥]", text)
        ),
        "has_table": "<table" in html.lower(),
        "has_list": "<ul" in html.lower() or "<ol" in html.lower(),
        "citation_matches": sum(len(p.findall(text)) for p in CITED),
        "example_values": [float(n.replace(",", ".")) for n in NUMBER.findall(text)[:20]],
    }


def measure(spark, pairs):
    rows = [(i, text, html) for i, (text, html) in enumerate(pairs)]
    frame = spark.createDataFrame(rows, "id int, text string, html string")
    found = extract_metrics(frame).orderBy("id").collect()
    return [{k: v for k, v in row["metrics"].asDict().items()} for row in found]


CASES = [
    ("", ""),
    ("Dieci parole in questo testo servono per contare senza errori", ""),
    ("Misure 2718,28 e 46692.016 nel brano", "<TABLE><tr></tr></TABLE>"),
    ("1,250,000 euro, 3D, 1.5x, 12x, 1.55x, x1, 2_3, 4é, é4, 5 6", "<ul><li>a</li></ul>"),
    ("formula \\begin{equation} x", "<Ol>"),
    ("prima \\[ a\nb \\] dopo", "<table"),
    ("a ≤ b", ""),
    ("scr prescribed variance var bscr SCR Solvency II solvency\nii Solvency II", ""),
    ("circolarex xnormativa normative normativa xregolamento regolamenti Regolamento", ""),
    ("IVASS ivassx xivass EIOPA. isvap,european insurance", ""),
    ("ÀÈ été_1 naïve ٣٤ ５６ x٣ ²", ""),
    (" ".join(str(n) for n in range(50)), ""),
]


def test_cases_match_python(spark):
    for (text, html), found in zip(CASES, measure(spark, CASES)):
        assert found == expected(text, html), text


def test_documents_match_python(spark, sf_dir):
    texts = [row["text"] for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for text, found in zip(texts, measure(spark, [(t, "") for t in texts])):
        assert found == expected(text)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aé_1٣ .,=IVivass\n ", max_size=40), min_size=20, max_size=60))
def test_random_text_matches_python(spark, texts):
    for text, found in zip(texts, measure(spark, [(t, "") for t in texts])):
        assert found == expected(text), text


@settings(max_examples=4, deadline=None)
@given(
    st.lists(st.text(alphabet="abé .*\n😀", min_size=1, max_size=5), min_size=1, max_size=60),
    st.lists(st.text(alphabet="abé .*\n😀", max_size=60), min_size=5, max_size=20),
)
def test_terms_of_a_large_lexicon_match_python(spark, terms, texts):
    lexicon = [*terms, *(f"filler {i}" for i in range(X.TERM_BY_TERM + 1))]
    rows = spark.createDataFrame([(t,) for t in [*texts, "", None, "filler 10" * 3]], "t string").coalesce(1)
    for row in rows.select("t", X.term_counts(F.col("t"), lexicon).alias("found")).collect():
        assert row["found"] == (None if row["t"] is None else {t: row["t"].count(t) for t in lexicon if t in row["t"]})


def test_long_terms_and_many_terms(spark):
    lexicon = ["x" * 2_000, *(f"{chr(97 + i % 26)}{i:04d} {i % 7}" for i in range(5_000))]
    text = "y" * 500 + "x" * 4_100 + " ".join(lexicon[1:200])
    row = spark.createDataFrame([(text,)], "t string").select(X.term_counts(F.col("t"), lexicon)).first()
    assert row[0] == {t: text.count(t) for t in lexicon if t in text}


def test_lexicon_is_a_parameter(spark):
    frame = spark.createDataFrame([("alfa beta alfa", "")], "text string, html string")
    row = extract_metrics(frame, lexicon=["alfa", "gamma", "alfa"]).first()
    assert row["metrics"]["actuarial_terms"] == {"alfa": 2}


@pytest.mark.parametrize("raw", ["  a b \n", "\x1c\x1fa\x85", "", " \t "])
def test_strip_matches_python(spark, raw):
    frame = spark.createDataFrame([(raw,)], "v string")
    assert frame.select(X.strip(F.col("v"))).first()[0] == raw.strip()
