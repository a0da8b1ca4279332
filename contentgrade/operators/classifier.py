"""Text classifier: TF-IDF features, multinomial logistic regression, class midpoints."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentgrade.operators.aggregates import classifier_metrics
from contentgrade.operators.logistic import LogisticFit, fit_logistic
from contentgrade.operators.regression import split
from contentgrade.operators.tfidf import (
    MAX_FEATURES,
    ROW_SCHEMA,
    Vocabulary,
    fit_tfidf,
    tfidf_transform,
)
from contentgrade.session import scratch_path

# Lower bounds of the classes 1 to 3, the score that stands for each class,
# and the seed of the split.
BOUNDS = (50.0, 70.0, 85.0)
MIDPOINTS = (25.0, 60.0, 77.5, 92.5)
SEED = 42


def bin_scores(score: Column) -> Column:
    """Score to class 0 to 3."""
    label = F.lit(0)
    for number, bound in enumerate(BOUNDS, start=1):
        label = F.when(score >= bound, F.lit(number)).otherwise(label)
    return label


def midpoint(label: Column) -> Column:
    return F.element_at(F.array(*[F.lit(value) for value in MIDPOINTS]), label.cast("int") + 1)


@dataclass
class TextModel:
    """Vocabulary and fitted regression; both are None before training."""

    vocabulary: Vocabulary | None = None
    regression: LogisticFit | None = None

    @property
    def is_trained(self) -> bool:
        return self.vocabulary is not None and self.regression is not None


@dataclass(frozen=True)
class Training:
    model: TextModel
    mae: float
    mse: float
    train_samples: int
    test_samples: int


def fit_classifier(
    rows: DataFrame,
    text: str = "text",
    score: str = "target_score",
    key: Sequence[str] = ("url",),
    test_size: float = 0.2,
    max_features: int = MAX_FEATURES,
    stop_words: Sequence[str] | None = None,
) -> Training:
    """Train on scored texts and measure on the held-out share.

    Fewer than four samples serve as train and test rows alike. Half the squares of the weights
    are the penalty on the sum of losses. Vocabulary and document weights come from the
    train rows only. Their vectors are written to the shared folder once, and each step of the fit
    adds up the shares of their rows in as many tasks as they have files. Neither the number
    of tasks nor their order changes the model (see ``logistic``).
    """
    counts = rows.agg(
        F.count("*").alias("n"), F.count(text).alias("texts"), F.count(score).alias("scores")
    ).first()
    if counts["n"] == 0:
        raise ValueError("no rows to train on")
    if not counts["n"] == counts["texts"] == counts["scores"]:
        raise ValueError("every row needs a text and a score")
    binned = rows.withColumn("_class", bin_scores(F.col(score)).cast("double"))
    if counts["n"] < 4:
        train, test = binned, binned
    else:
        n_test = math.ceil(test_size * counts["n"])
        train, test = split(binned, key, test_size, SEED, n_test=n_test)
    sizes = train.groupBy("_class").count().orderBy("_class").collect()
    classes, samples = tuple(int(row["_class"]) for row in sizes), sum(row["count"] for row in sizes)
    if len(classes) < 2:
        raise ValueError("training needs rows of at least two classes")
    vocabulary = fit_tfidf(train, text, max_features, stop_words)
    places = F.create_map(*[F.lit(x) for place, label in enumerate(classes) for x in (label, place)])
    entries = F.filter(
        F.transform(vector_to_array("features"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e["x"] != 0
    )
    vectors = tfidf_transform(train, vocabulary, text).select(
        places[F.col("_class").cast("int")].alias("label"), entries.alias("_entries")
    )
    path = scratch_path(rows.sparkSession, "training-vectors")
    vectors.select("label", F.col("_entries.i").alias("indices"), F.col("_entries.x").alias("values")).write.parquet(path)
    stored = rows.sparkSession.read.parquet(path)
    regression = fit_logistic(stored, classes, len(vocabulary.terms), samples)
    model = TextModel(vocabulary, regression)
    predicted = predict_scores(model, test, text).withColumn("_actual", midpoint(F.col("_class")))
    errors = classifier_metrics(predicted, "_actual", "predicted_score").first()
    return Training(model, errors["mae"], errors["mse"], samples, errors["samples"])


def predict_scores(model: TextModel, rows: DataFrame, text: str = "text") -> DataFrame:
    """Add ``predicted_class`` and ``predicted_score``, the midpoint of that class."""
    if model is None or not model.is_trained:
        raise RuntimeError("the model is not trained")
    featured = tfidf_transform(rows, model.vocabulary, text, "_features")
    return (
        featured.withColumn("predicted_class", model.regression.predicted(vector_to_array("_features")).cast("int"))
        .withColumn("predicted_score", midpoint(F.col("predicted_class")))
        .drop("_features")
    )


def save_model(model: TextModel, path: str) -> None:
    """Write the vocabulary and the regression below ``path``, replacing what is there."""
    if not model.is_trained:
        raise RuntimeError("only a trained model can be saved")
    spark = SparkSession.active()
    vocabulary = model.vocabulary
    rows = [(i, *row) for i, row in enumerate(vocabulary.rows())]
    table = spark.createDataFrame(rows, f"position int, {ROW_SCHEMA}")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/vocabulary")
    facts = json.dumps({"documents": vocabulary.documents, "stop_words": vocabulary.stop_words})
    spark.createDataFrame([(facts,)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/facts"
    )
    fit = model.regression
    weights = list(zip(fit.classes, fit.intercepts, fit.weights))
    table = spark.createDataFrame(weights, "label int, intercept double, weights array<double>")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/regression")


def load_model(spark: SparkSession, path: str) -> TextModel:
    """Read a saved model; a missing path is an error."""
    try:
        rows = spark.read.parquet(f"{path}/vocabulary").orderBy("position").collect()
        facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Model not found: {path}") from error
        raise
    vocabulary = Vocabulary(
        tuple(row["term"] for row in rows),
        tuple(row["corpus_count"] for row in rows),
        tuple(row["document_count"] for row in rows),
        tuple(row["idf"] for row in rows),
        facts["documents"],
        tuple(facts["stop_words"]),
    )
    fitted = spark.read.parquet(f"{path}/regression").orderBy("label").collect()
    regression = LogisticFit(
        tuple(row["label"] for row in fitted),
        tuple(tuple(row["weights"]) for row in fitted),
        tuple(row["intercept"] for row in fitted),
    )
    return TextModel(vocabulary, regression)
