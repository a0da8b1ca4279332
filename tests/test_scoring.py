"""Scores: components, composites, classes, rounding."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from contentgrade.functions import scores as S
from contentgrade.functions.rounding import round2
from contentgrade.operators import aggregates, scoring
from contentgrade.plans.evaluate import evaluate_pages

AS_OF = "2024-06-01T12:00:00+00:00"
METRICS = (
    "struct<word_count: bigint, actuarial_terms: map<string,int>, numeric_tokens: bigint, has_formula: boolean,"
    " has_table: boolean, has_list: boolean, citation_matches: bigint, example_values: array<double>>"
)
METADATA = "struct<modified: string, published: string>"


def page(url="u", words=100, terms=(), numbers=0, formula=False, table=False, lists=False, cited=0, modified=None, published=None):
    metrics = (words, {t: 1 for t in terms}, numbers, formula, table, lists, cited, [])
    return (url, metrics, (modified, published))


def frame(spark, *pages):
    return spark.createDataFrame(list(pages), f"url string, metrics {METRICS}, metadata {METADATA}")


def components(spark, *pages):
    rows = scoring.compute_components(frame(spark, *pages), AS_OF).collect()
    return [row["components"].asDict() for row in rows]


def test_component_formulas(spark):
    empty, rich, dense, some = components(
        spark,
        page(words=0),
        page(words=500, terms="abcdefg", numbers=50, formula=True, table=True, lists=True, cited=9),
        page(words=100, numbers=50),
        page(words=100, numbers=15, cited=1, terms="ab"),
    )
    assert empty == {"accuracy": 40, "transparency": 30, "completeness": 40, "freshness": 50, "clarity": 40}
    assert rich == {"accuracy": 90, "transparency": 100, "completeness": 100, "freshness": 50, "clarity": 80}
    assert dense["accuracy"] == 100 and dense["clarity"] == 65
    assert some["accuracy"] == pytest.approx(90) and some["clarity"] == 80
    assert some["transparency"] == 45 and some["completeness"] == 50


def freshness(text, now):
    if not text:
        return 50.0
    try:
        parsed = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return 60.0
    parsed = parsed if parsed.tzinfo else parsed.replace(tzinfo=dt.timezone.utc)
    days = (now - parsed).days
    return 80.0 if days < 0 else max(20.0, 100.0 * (1 - min(days / 365, 1.0)))


def test_freshness_matches_python_dates(spark):
    texts = [
        None, "", "n/a", "2024-05-31", "2024-06-01T12:00:00Z", "2024-06-01T12:00:01+00:00", "2024-06-01T14:00:00+02:00",
        "2023-06-20", "20230620", "20230620T101500Z", "2023-06-20 10:15", "2023-06-20T10", "2023-06-20T10:15:30.5",
        "2023-06-20T10:15:30,123456789-05:30", "2023-06-20T24:00:00", "2023-02-30", "2023", "2023-06", "2023-6-2",
        "2023-06-20T10:15:30+0200", "2023-06-20T10:15:30 +02:00", "2023-06-20T", "1999-01-01", " 2024-01-01",
        "2023-06-20T10:15:30+02", "3000-01-01", "2023-06-20T10:15:30.5 +02:00", "2024-05-20T1015", "2024-05-20T101530.25+0200",
    ]
    now = dt.datetime.fromisoformat(AS_OF)
    rows = components(spark, *[page(modified=t) for t in texts])
    for text, row in zip(texts, rows):
        assert row["freshness"] == pytest.approx(freshness(text, now)), text


def test_modified_goes_before_published(spark):
    both, empty = components(
        spark, page(modified="2024-06-01", published="2000-01-01"), page(modified="", published="2024-06-01")
    )
    assert both["freshness"] == empty["freshness"] == 100.0


def test_weights(spark):
    with pytest.raises(ValueError, match="Weights sum to zero"):
        S.Weights(0, 0, 0, 0, 0).normalized()
    assert S.Weights.from_dict({"accuracy": 2, "other": 1}) == S.Weights(accuracy=2.0)
    parts = F.struct(*[F.lit(v).alias(n) for n, v in zip(S.COMPONENTS, (80.0, 70.0, 60.0, 50.0, 90.0))])
    one = spark.range(1).withColumn("components", parts)
    doubled = scoring.apply_weights(one, S.Weights(0.8, 0.4, 0.4, 0.2, 0.2)).first()["composite"]
    assert doubled == pytest.approx(80 * 0.4 + 70 * 0.2 + 60 * 0.2 + 50 * 0.1 + 90 * 0.1)
    sets = scoring.apply_weight_sets(one, {"a": S.Weights(), "b": S.Weights(1, 0, 0, 0, 0)}).collect()
    assert {r["weight_set"]: round(r["composite"], 6) for r in sets} == {"a": 72.0, "b": 80.0}
    by_column = scoring.apply_weights(one, S.Weights(3.0).as_column()).first()["composite"]
    assert by_column == pytest.approx(scoring.apply_weights(one, S.Weights(3.0)).first()["composite"])
    with pytest.raises(Exception, match="Weights sum to zero"):
        scoring.apply_weights(one, S.Weights(0, 0, 0, 0, 0).as_column()).collect()


def test_missing_component_counts_as_zero(spark):
    parts = F.struct(*[F.lit(None if n == "clarity" else 100.0).cast("double").alias(n) for n in S.COMPONENTS])
    row = scoring.apply_weights(spark.range(1).withColumn("components", parts), S.Weights()).first()
    assert row["composite"] == pytest.approx(90.0)


def test_classes(spark):
    frame_ = spark.createDataFrame([(85.0,), (84.999,), (70.0,), (50.0,), (49.99,)], "v double")
    found = [r[0] for r in frame_.select(S.classify(F.col("v"))).collect()]
    assert found == ["Eccellente", "Buono", "Buono", "Discreto", "Criticità"]


def test_rounding_matches_python(spark):
    rng = random.Random(3)
    values = [rng.uniform(0, 100) for _ in range(3000)]
    values += [rng.randrange(0, 100000) / 1000 for _ in range(3000)]
    values += [k / 8 for k in range(800)] + [2.675, 1.005, 0.005, 47.125, 99.995, 0.0, 100.0]
    values += [rng.randrange(0, 20000) / 200 + rng.choice([-1e-14, 0, 1e-14, 1e-9]) for _ in range(3000)]
    values = [abs(v) for v in values]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for value, found in rows.select("v", round2(F.col("v"))).collect():
        assert found == round(value, 2), value


def test_score_keeps_class_of_unrounded_composite(spark):
    # 0.4 * 90 + 0.2 * (100 + 90) + 0.1 * (x + 80) with freshness just below the bound.
    row = scoring.score_heuristic(frame(spark, page(None, 500, "abcdefgh", 50, True, True, True, 5)), S.Weights(), AS_OF).first()
    score = row["score"]
    assert score["url"] == "" and score["components"]["ml_score"] is None
    assert score["composite"] == round(0.4 * 90 + 0.2 * 100 + 0.2 * 100 + 5 + 8, 2)
    total = spark.createDataFrame([(84.996,)], "v double").select(round2(F.col("v")), S.classify(F.col("v"))).first()
    assert tuple(total) == (85.0, "Buono")


def test_predicted_and_hybrid(spark):
    pages = scoring.score_heuristic(frame(spark, page(numbers=5)), S.Weights(), AS_OF).withColumn(
        "predicted_score", F.lit(92.5)
    )
    heuristic = pages.first()["score"]
    alone = scoring.score_predicted(pages).first()["score"]
    assert alone["composite"] == 92.5 and set(alone["components"].asDict().values()) == {92.5}
    mixed = scoring.score_hybrid(pages).first()["score"]
    assert mixed["composite"] == round((heuristic["composite"] + 92.5) / 2, 2)
    assert mixed["components"]["accuracy"] == heuristic["components"]["accuracy"]
    assert mixed["components"]["ml_score"] == 92.5


GOLDEN_TEXT = (
    "<p>Solvency II and IVASS with EIOPA. Best estimate, risk margin and SCR after the stress test.</p>"
    "<p>Prescribed solvency II best estimate risk margin of scr and solvency: "
    "1,250,000 or 1.5, 2, 3, 4, 5, 6, 7, 8 and 9</p>"
)


def test_golden_page(spark):
    """Published score of a page with these counts: 82.15, Buono; hybrid with 92.5: 87.33."""
    words = len(re.findall(r"\w+", re.sub("<[^>]+>", " ", GOLDEN_TEXT)))
    html = (
        f"<html><head><title>T</title></head><body>{GOLDEN_TEXT}<table></table><ul></ul>"
        f"<p>{'parola ' * (123 - words)}</p></body></html>"
    )
    fetches = spark.createDataFrame([("u", html, 1.0, None)], "url string, html string, fetched_at double, error string")
    row = evaluate_pages(fetches, AS_OF).first()
    metrics = row["metrics"].asDict()
    assert metrics["word_count"] == 123 and metrics["numeric_tokens"] == 11 and metrics["citation_matches"] == 4
    assert metrics["actuarial_terms"] == {
        "best estimate": 2, "eiopa": 1, "ivass": 1, "risk margin": 2, "scr": 3, "solvency": 3, "solvency ii": 2, "stress test": 1,
    }
    assert not metrics["has_formula"] and metrics["has_table"] and metrics["has_list"]
    components_ = row["score"]["components"].asDict()
    assert components_ == {
        "accuracy": 77.89, "transparency": 90.0, "completeness": 100.0, "freshness": 50.0, "clarity": 80.0, "ml_score": None,
    }
    assert (row["score"]["composite"], row["score"]["classification"]) == (82.15, "Buono")
    hybrid = scoring.score_hybrid(evaluate_pages(fetches, AS_OF).withColumn("predicted_score", F.lit(92.5))).first()
    assert hybrid["score"]["composite"] in (87.32, 87.33) and hybrid["score"]["classification"] == "Eccellente"
    assert hybrid["score"]["composite"] == round((82.15 + 92.5) / 2, 2)


def test_mode_errors(spark):
    fetches = spark.createDataFrame([], "url string, html string, fetched_at double, error string")
    with pytest.raises(ValueError, match="unknown scoring mode"):
        evaluate_pages(fetches, AS_OF, mode="other")
    with pytest.raises(ValueError, match="trained model"):
        evaluate_pages(fetches, AS_OF, mode="ml")


def test_summary_and_top(spark):
    rows = spark.createDataFrame(
        [("b", 80.0), ("a", 80.0), ("c", 50.11), ("d", 90.5)], "url string, composite double"
    ).select("url", F.struct("composite").alias("score"))
    assert aggregates.summary(rows).first().asDict() == {
        "count": 4, "average": 75.15, "minimum": 50.11, "maximum": 90.5,
    }
    assert aggregates.summary(rows.limit(0)).first().asDict() == {
        "count": 0, "average": 0.0, "minimum": 0.0, "maximum": 0.0,
    }
    assert [r["url"] for r in aggregates.top_pages(rows, 3).collect()] == ["d", "a", "b"]


def test_scores_stay_in_range(spark, sf_dir):
    from checks import fixtures

    rows = evaluate_pages(fixtures.fetches(spark, sf_dir), AS_OF).select("score.*").collect()
    for row in rows:
        values = [v for k, v in row["components"].asDict().items() if k != "ml_score"]
        assert all(0 <= v <= 100 for v in values)
        assert min(values) <= row["composite"] <= max(values)


def test_filters_on_results_do_not_repeat_the_work(spark, sf_dir):
    import time

    from contentgrade.plans.evaluate import evaluate_pages

    fetches = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "url", "html", F.lit(0.0).alias("fetched_at"), F.lit(None).cast("string").alias("error")
    )
    for condition in ("title != ''", "text != ''", "metrics.word_count > 10", "score.classification = 'x'", "score.composite > 1"):
        start = time.perf_counter()
        plan = evaluate_pages(fetches, "2024-06-01").filter(condition)._jdf.queryExecution()
        optimized = plan.optimizedPlan().toString()
        physical = plan.executedPlan().toString()
        assert time.perf_counter() - start < 5
        assert optimized.count("<(?:!--") == 1
        assert "Exchange" not in physical


def test_seconds_of_a_zone_count(spark):
    cases = ["2024-03-01T10:00:00+01:00:30", "2024-03-01T10:00:00-05:30:15", "2024-03-01T10:00:00+01:00", "2024-03-01T10:00:00.25+00:00:01"]
    frame = spark.createDataFrame([(c,) for c in cases], "v string")
    found = [r[0] for r in frame.select(F.unix_micros(S.iso_timestamp(F.col("v")))).collect()]
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    assert found == [(dt.datetime.fromisoformat(c) - epoch) // dt.timedelta(microseconds=1) for c in cases]
