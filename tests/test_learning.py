"""Labels, least squares, calibration and the text model."""

import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from contentgrade.functions.scores import COMPONENTS, Weights
from contentgrade.operators import classifier as C
from contentgrade.operators import logistic
from contentgrade.operators.logistic import LogisticFit, fit_logistic
from contentgrade.operators.calibration import learn_weights
from contentgrade.operators.labels import match_labels
from contentgrade.operators.regression import fit_evaluate, fit_ols, prepare, split
from contentgrade.operators import tfidf
from contentgrade.operators.tfidf import english_stop_words, fit_tfidf, tfidf_transform
from contentgrade.plans.evaluate import calibrate_weights, evaluate_pages, train_text_model
from contentgrade.session import shared_dir
from contentgrade.sources.labels import array_objects, read_labels, unique_labels


def write(tmp_path, value, name="labels.json"):
    path = tmp_path / name
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(path)


def test_read_labels(spark, tmp_path):
    path = write(
        tmp_path,
        [
            {"url": "http://h.example/a/", "target_score": 10},
            {"url": "https://h.example/a", "target_score": "85.5"},
            {"url": "https://h.example/zero", "target_score": 0},
            {"url": "https://h.example/none"}, {"url": "", "target_score": 3}, {"target_score": 3}, "text", 7, None, [1],
            {"url": "https://h.example/null", "target_score": None},
        ],
    )
    found = {r["url_key"]: (r["url"], r["target_score"]) for r in read_labels(spark, path).collect()}
    assert found == {
        "https://h.example/a": ("https://h.example/a", 85.5),
        "https://h.example/zero": ("https://h.example/zero", 0.0),
    }


@pytest.mark.parametrize("block", [1 << 27, 997, 64])
def test_a_label_array_is_read_by_many_tasks(spark, tmp_path, block):
    """Strings hold quotes, escapes, braces and brackets, and blocks begin anywhere in them."""
    generator = random.Random(block)
    signs = ['"', "\\", "{", "}", "[", "]", ",", "é", "\n", " ", "x"]

    def text(n):
        return "".join(generator.choices(signs, k=n))

    def entry(i):
        kind = generator.randrange(8)
        if kind == 0:
            return generator.choice([7, None, True, text(9), [1, {"url": "no", "target_score": 1}], [], {}, text(0)])
        note = [text(generator.randrange(30)), {"deep": [{"er": text(5)}, text(3)]}][kind % 2]
        return {"note": note, "url": f"https://h.example/{i}", "target_score": i, text(4): note}

    arrays = [[entry(i) for i in range(k, k + 150)] for k in (0, 1000)] + [[5], [], [{"url": "https://h.example/last", "target_score": 3}]]
    for k, entries in enumerate(arrays):
        write(tmp_path, json.dumps(entries, ensure_ascii=k % 2 == 0, indent=k or None), f"part{k}.json")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        found = array_objects(spark, str(tmp_path)).collect()
        tasks = array_objects(spark, str(tmp_path / "part0.json")).select("file").count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for k, entries in enumerate(arrays):
        mine = sorted((r["pos"], r["entry"]) for r in found if r["file"].endswith(f"part{k}.json") and r["pos"] is not None)
        assert [json.loads(e) for _, e in mine] == [e for e in entries if isinstance(e, dict)]
        assert len({pos for pos, _ in mine}) == len(mine)
    assert tasks > 100


@pytest.mark.parametrize("value", [{"url": "u", "target_score": 1}, [], [{"url": "u"}], "nonsense", "5", '[{"url": "u", "target_score": 1}', '[{"url": "u", "target_score": 1'])
def test_read_labels_errors(spark, tmp_path, value):
    with pytest.raises(Exception, match="JSON array|no valid label"):
        read_labels(spark, write(tmp_path, value))


def test_match_labels_keeps_copies(spark):
    pages = spark.createDataFrame(
        [("https://h.example/a", 1.0)] * 50 + [("https://h.example/a/", 2.0), ("https://h.example/b", 1.0)],
        "url string, fetched_at double",
    )
    labels = unique_labels(spark.createDataFrame([("http://h.example/a//", 7.0, 0)], "url string, target_score double, pos int"))
    assert [r["target_score"] for r in match_labels(pages, labels).collect()] == [7.0] * 51


def test_prepare(spark):
    rows = spark.createDataFrame(
        [("1", 2.0, "x"), ("a", 2.0, "x"), (None, 1.0, "x"), ("3", float("nan"), "x"), (" 4 ", 5.0, "x")],
        "f string, y double, other string",
    )
    assert [tuple(r) for r in prepare(rows, "y", ["f"]).orderBy("f").collect()] == [(1.0, 2.0), (4.0, 5.0)]
    assert prepare(rows.drop("other"), "y").columns == ["f", "y"]


@pytest.mark.parametrize("size,expected", [(0.2, 200), (0.0, 1), (5.0, 900), (-1, 1), (0.0015, 2)])
def test_exact_split(spark, size, expected):
    rows = spark.range(1000)
    train, test = split(rows, ["id"], size, seed=3)
    a, b = {r[0] for r in train.collect()}, {r[0] for r in test.collect()}
    assert len(b) == expected and not a & b and len(a | b) == 1000
    again = {r[0] for r in split(rows.repartition(7), ["id"], size, seed=3)[1].collect()}
    assert again == b


def test_ranged_split(spark):
    train, test = split(spark.range(20000), ["id"], 0.3, seed=1, exact=False)
    assert train.count() + test.count() == 20000 and abs(test.count() - 6000) < 300
    assert split(spark.range(100), ["id"], 0.2, 1)[1].collect() != split(spark.range(100), ["id"], 0.2, 2)[1].collect()


def test_ols_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = 2 * x[:, 0] - 0.5 * x[:, 1] + 4 + rng.normal(0, 0.3, 400)
    rows = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    fit = fit_ols(rows, "y", ["a", "b", "c"])
    expected, *_ = np.linalg.lstsq(np.hstack([np.ones((400, 1)), x]), y, rcond=None)
    assert [fit.intercept, *fit.coefficients.values()] == pytest.approx(list(expected), abs=1e-8)
    doubled = rows.withColumn("b", F.col("a"))
    same = fit_ols(doubled, "y", ["a", "b"]).coefficients
    assert same["a"] == pytest.approx(same["b"], abs=1e-4)


def test_fit_evaluate(spark):
    rows = spark.range(300).select(F.col("id"), (F.col("id") % 17).cast("double").alias("x")).withColumn("y", F.col("x") * 3 + 1)
    found = fit_evaluate(rows, "y", ["x"], key=["id"]).first()
    assert found["mae"] == pytest.approx(0, abs=1e-9) and found["r2"] == pytest.approx(1)
    tiny = fit_evaluate(rows.limit(2).drop("id"), "y", ["x"]).first()
    assert (tiny["mae"], tiny["rmse"], tiny["r2"], tiny["ss_tot"]) == (1.5, 1.5, 0.0, 4.5)
    flat = fit_evaluate(rows.withColumn("y", F.lit(5.0)), "y", ["x"], key=["id"]).first()
    assert flat["r2"] == 0.0


def results(spark, rows):
    parts = F.struct(*[F.col(c) for c in COMPONENTS])
    frame = spark.createDataFrame(rows, "url string, " + ", ".join(f"{c} double" for c in COMPONENTS))
    return frame.select("url", F.struct(parts.alias("components")).alias("score"))


def test_learn_weights_recovers_weights(spark):
    rng = random.Random(1)
    rows = [(f"https://h.example/{i}", *[rng.uniform(0, 100) for _ in COMPONENTS]) for i in range(80)]
    true = Weights(0.1, 0.3, 0.2, 0.25, 0.15)
    scores = [sum(w * v for w, v in zip(true.as_dict().values(), r[1:])) for r in rows]
    entries = spark.createDataFrame([(r[0], s, i) for i, (r, s) in enumerate(zip(rows, scores))], "url string, target_score double, pos int")
    found = learn_weights(results(spark, rows), unique_labels(entries))
    assert list(found.weights.as_dict().values()) == pytest.approx(list(true.as_dict().values()), abs=1e-6)
    assert found.mae == pytest.approx(0, abs=1e-6) and found.samples == 80
    constant = [(*r[:4], 50.0, r[5]) for r in rows]
    assert sum(learn_weights(results(spark, constant), unique_labels(entries)).weights.as_dict().values()) == pytest.approx(1)
    with pytest.raises(ValueError, match="No pages matched"):
        learn_weights(results(spark, [("https://other.example/", 1.0, 1.0, 1.0, 1.0, 1.0)]), unique_labels(entries))


TEXTS = ["Solvency ratio of the insurer", "the insurer ratio and A solvency ratio", "", "è già scritto già a b", "ratio_1 42 ratio"]


def test_tfidf_matches_a_plain_computation(spark):
    stop = set(english_stop_words())
    docs = []
    for text in TEXTS:
        words = [w for w in re.findall(r"\w\w+", text.lower()) if w not in stop]
        docs.append(Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))
    total, df = sum(docs, Counter()), Counter(t for d in docs for t in d)
    chosen = sorted(total, key=lambda t: (-total[t], t))[:6]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in chosen}
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    vocabulary = fit_tfidf(rows, max_features=6)
    assert list(vocabulary.terms) == chosen
    assert vocabulary.rows() == [(t, total[t], df[t], pytest.approx(idf[t])) for t in chosen]
    for row in tfidf_transform(rows, vocabulary).select("id", vector_to_array("features").alias("v")).collect():
        raw = [docs[row["id"]][t] * idf[t] for t in chosen]
        norm = math.sqrt(sum(v * v for v in raw))
        assert row["v"] == pytest.approx([v / norm if norm else 0.0 for v in raw])


@pytest.mark.parametrize("tracked,buckets", [(1 << 14, 128), (32, 1)])
def test_frequent_terms_are_exact_however_small_the_summary(spark, monkeypatch, tracked, buckets):
    """A summary of 32 terms misses most of them, and few buckets are mostly full."""
    monkeypatch.setattr(tfidf, "TRACKED", tracked)
    monkeypatch.setattr(tfidf, "BUCKETS", buckets)
    shared_dir(spark)
    generator = random.Random(7)
    # Flat counts: many terms are as frequent as the last that is taken.
    values = [f"t{generator.randrange(400)}" for _ in range(6000)] + ["much"] * 900
    rows = spark.createDataFrame([(v,) for v in values], "term string").repartition(6)
    counts = Counter(values)
    for size in (1, 3, 4, 200, 401, 5000):
        expected = sorted(counts.items(), key=lambda t: (-t[1], t[0]))[:size]
        assert tfidf.top_terms(rows, size) == expected
    assert tfidf.top_terms(rows.limit(0), 4) == []


def test_frequent_terms_are_mostly_counted_once(spark, monkeypatch):
    """Counts fall slowly behind the last term taken, as those of words do, so its successors nearly reach it."""
    shared_dir(spark)
    values = [f"t{i}" for i in range(60) for _ in range(400 - i)]
    rows = spark.createDataFrame([(v,) for v in values], "term string").repartition(4)
    expected = [(f"t{i}", 400 - i) for i in range(20)]
    sorts = []
    sort = type(rows).orderBy
    monkeypatch.setattr(type(rows), "orderBy", lambda *given: sorts.append(1) or sort(*given))
    # Every bucket holds some rare terms, which together with the next frequent one are as many as the last.
    monkeypatch.setattr(tfidf, "BUCKETS", 128)
    monkeypatch.setattr(tfidf, "_likely", lambda terms, n: spark.createDataFrame([(f"t{i}",) for i in range(n)], "term string"))
    more = rows.unionByName(spark.createDataFrame([(f"r{i}",) for i in range(10 * 128 * 20)], "term string"))
    assert tfidf.top_terms(more, 20) == expected and not sorts


def scored_texts(spark, n=40):
    rows = [(i, f"bond yield curve number{i}" if i % 2 else f"cooking pasta recipe number{i}", 90.0 if i % 2 else 30.0) for i in range(n)]
    return spark.createDataFrame(rows, "id int, text string, target_score double")


def test_bins_cap_at_three(spark):
    rows = spark.createDataFrame([(v,) for v in (0.0, 49.9, 50.0, 70.0, 84.9, 85.0, 100.0, 140.0)], "v double")
    assert [r[0] for r in rows.select(C.bin_scores(F.col("v"))).collect()] == [0, 0, 1, 2, 2, 3, 3, 3]


def test_classifier_learns_and_survives_storage(spark, tmp_path):
    found = C.fit_classifier(scored_texts(spark), key=["id"])
    assert (found.train_samples, found.test_samples, found.mae, found.mse) == (32, 8, 0.0, 0.0)
    new = spark.createDataFrame([("yield curve of a bond",), ("pasta recipe",)], "text string")
    scores = [r["predicted_score"] for r in C.predict_scores(found.model, new).collect()]
    assert scores == [92.5, 25.0]
    C.save_model(found.model, str(tmp_path / "m"))
    loaded = C.load_model(spark, str(tmp_path / "m"))
    assert loaded.vocabulary == found.model.vocabulary
    assert [r["predicted_score"] for r in C.predict_scores(loaded, new).collect()] == scores


def test_least_squares_keeps_digits_and_takes_the_shortest_answer(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(900, 3))
    x = np.column_stack([x, x[:, 0] + 1e-7 * r.normal(size=900)])
    y = x @ [2.0, -1.0, 0.5, 3.0] + 0.25
    rows = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, d double, y double")
    for parts in (1, 40):
        fit = fit_ols(rows.repartition(parts), "y", ["a", "b", "c", "d"])
        found = [*fit.coefficients.values(), fit.intercept]
        assert np.allclose(found, [2.0, -1.0, 0.5, 3.0, 0.25], rtol=0, atol=1e-6)
        # A column that is a multiple of another shares its weight with it.
        twice = rows.repartition(parts).withColumn("e", 2 * F.col("b"))
        shortest = list(fit_ols(twice, "y", ["b", "c", "e"]).coefficients.values())
        exact = np.linalg.lstsq(np.column_stack([x[:, 1], x[:, 2], 2 * x[:, 1], np.ones(900)]), y, rcond=None)[0]
        assert np.allclose(shortest, exact[:3], atol=1e-9)
    with pytest.raises(ValueError, match="numbers"):
        fit_ols(rows.withColumn("a", F.when(F.col("a") > 0, F.col("a"))), "y", ["a", "b"])


def test_logistic_fit_is_the_same_for_any_partitioning(spark):
    r = np.random.default_rng(4)
    dense = r.normal(size=(90, 5)) * (r.random((90, 5)) < 0.7)
    labels = (dense[:, :3] + r.normal(size=(90, 3))).argmax(axis=1)
    for classes in ((0, 3), (0, 1, 3)):
        rows = [
            (int(y), [int(j) for j in np.flatnonzero(x)], [float(v) for v in x[x != 0]])
            for x, y in zip(dense, labels) if y < len(classes)
        ]
        table = spark.createDataFrame(rows, "label int, indices array<int>, values array<double>")
        fits = [fit_logistic(table.repartition(n), classes, 5, len(rows)) for n in (1, 7, 64)]
        assert fits[0] == fits[1] == fits[2]
        # At the minimum the slope of the penalised loss is zero; checked with dense arithmetic.
        x = np.array([np.bincount(i, v, 5) if i else np.zeros(5) for _, i, v in rows])
        y = np.array([label for label, _, _ in rows])
        w, b = np.array(fits[0].weights), np.array(fits[0].intercepts)
        z = x @ w.T + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        gap = p - (y[:, None] == np.arange(len(classes)))
        assert np.abs(gap.T @ x + w)[1:].max() < 2e-5 and np.abs(gap.sum(axis=0)).max() < 2e-5


@pytest.mark.parametrize("curved", [1000, 40])
def test_logistic_fit_takes_few_passes_whatever_the_number_of_rows(spark, monkeypatch, curved):
    """Frequent features among rare ones, as terms are: plain steps need more passes the more rows there are."""
    monkeypatch.setattr(logistic, "CURVED", curved)
    passes = []
    totals = logistic._totals
    monkeypatch.setattr(logistic, "_totals", lambda *given: passes.append(1) or totals(*given))
    r = np.random.default_rng(5)
    dense = (r.random((4000, 60)) < np.minimum(1.8 / np.arange(1, 61) ** 0.7, 0.9)) * r.random((4000, 60))
    labels = r.integers(0, 4, 4000)
    rows = [(int(y), [int(j) for j in np.flatnonzero(x)], [float(v) for v in x[x != 0]]) for x, y in zip(dense, labels)]
    table = spark.createDataFrame(rows, "label int, indices array<int>, values array<double>")
    fit = fit_logistic(table, (0, 1, 2, 3), 60, 4000)
    assert len(passes) < 30
    w = np.array(fit.weights)
    z = dense @ w.T + np.array(fit.intercepts)
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.abs((p - (labels[:, None] == np.arange(4))).T @ dense + w).max() < 5e-5


def test_the_inverse_of_a_positive_matrix():
    x = np.random.default_rng(6).normal(size=(90, 40))
    assert np.allclose(logistic._inverse(x.T @ x) @ (x.T @ x), np.eye(40), atol=1e-10)


def test_margins_choose_the_smallest_of_equal_classes(spark):
    fit = LogisticFit((0, 2), ((0.0, 0.0), (1.0, -1.0)), (0.0, 0.0))
    rows = spark.createDataFrame([([1.0, 1.0],), ([2.0, 1.0],), ([0.0, 1.0],)], "x array<double>")
    assert [r[0] for r in rows.select(fit.predicted(F.col("x"))).collect()] == [0, 2, 0]


def test_classifier_errors(spark, tmp_path):
    rows = scored_texts(spark)
    with pytest.raises(ValueError, match="no rows"):
        C.fit_classifier(rows.limit(0), key=["id"])
    with pytest.raises(ValueError, match="text and a score"):
        C.fit_classifier(rows.withColumn("target_score", F.when(F.col("id") > 3, F.col("target_score"))), key=["id"])
    with pytest.raises(ValueError, match="two classes"):
        C.fit_classifier(rows.filter("target_score > 50"), key=["id"])
    with pytest.raises(RuntimeError, match="trained"):
        C.predict_scores(C.TextModel(), rows)
    with pytest.raises(RuntimeError, match="only a trained"):
        C.save_model(C.TextModel(), str(tmp_path / "m"))
    with pytest.raises(FileNotFoundError):
        C.load_model(spark, str(tmp_path / "missing"))


def test_small_samples_are_train_and_test(spark):
    found = C.fit_classifier(scored_texts(spark, 3), key=["id"])
    assert (found.train_samples, found.test_samples) == (3, 3)


def test_train_and_score_with_the_model(spark):
    html = "<body>{}</body>"
    rows = [(f"https://h.example/{r['id']}", html.format(r["text"]), float(r["id"]), None) for r in scored_texts(spark).collect()]
    fetches = spark.createDataFrame(rows, "url string, html string, fetched_at double, error string")
    labels = unique_labels(
        scored_texts(spark).select(F.concat(F.lit("http://h.example/"), "id", F.lit("/")).alias("url"), "target_score", F.col("id").alias("pos"))
    )
    pages = evaluate_pages(fetches, "2024-01-01")
    found = train_text_model(pages, labels)
    assert train_text_model(fetches, labels).model.vocabulary == found.model.vocabulary
    ml = evaluate_pages(fetches, "2024-01-01", mode="ml", model=found.model).select("score.*").collect()
    assert {(r["composite"], r["classification"]) for r in ml} == {(92.5, "Eccellente"), (25.0, "Criticità")}
    hybrid = evaluate_pages(fetches, "2024-01-01", mode="hybrid", model=found.model).select("score.*").collect()
    assert {r["components"]["ml_score"] for r in hybrid} == {92.5, 25.0}
    calibrated = calibrate_weights(fetches, labels, "2024-01-01")
    assert calibrated.weights == learn_weights(pages, labels).weights and calibrated.samples == 40
    with pytest.raises(ValueError, match="No pages matched"):
        train_text_model(pages, labels.withColumn("url_key", F.lit("x")))


def test_scores_that_are_no_numbers(spark, tmp_path):
    path = write(tmp_path, [{"url": "https://h/a", "target_score": True}, {"url": "https://h/b", "target_score": " 7 "}, {"url": "https://h/c", "target_score": None}])
    assert sorted(r["target_score"] for r in read_labels(spark, path).collect()) == [1.0, 7.0]
    for wrong in ("abc", "true", [1]):
        path = write(tmp_path, [{"url": "https://h/a", "target_score": 3}, {"url": "https://h/b", "target_score": wrong}])
        with pytest.raises(Exception, match="not a score"):
            read_labels(spark, path).collect()


def test_nothing_left_to_train_on(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 7.0)], "x double, y double")
    found = fit_evaluate(rows, "y", ["x"], test_size=0.9).first()
    assert found["mae"] == pytest.approx(13 / 3)
