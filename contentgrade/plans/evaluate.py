"""Fetches to scored pages, and labels to models."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from contentgrade.functions import text as X
from contentgrade.functions.scores import Weights
from contentgrade.operators import scoring as S
from contentgrade.operators.calibration import Calibration, learn_weights
from contentgrade.operators.classifier import TextModel, Training, fit_classifier, predict_scores
from contentgrade.operators.labels import match_labels
from contentgrade.operators.metrics import extract_metrics
from contentgrade.operators.pages import parse_pages, usable_fetches
from contentgrade.session import shared_dir

MODES = ("heuristic", "ml", "hybrid")


def evaluate_pages(
    fetches: DataFrame,
    as_of: dt.datetime | str | Column,
    mode: str = "heuristic",
    weights: Weights | None = None,
    model: TextModel | None = None,
    language: str = "it",
    lexicon: Sequence[str] = X.DOMAIN_TERMS,
    citation_patterns: Sequence[str] = X.CITATION_PATTERNS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per usable fetch with ``metadata``, ``metrics`` and ``score`` structs.

    In every mode this is one stage of scan, filter and projections; it never shuffles and
    runs unchanged over a streaming table. Modes ``ml`` and ``hybrid`` need a trained model.
    """
    if mode not in MODES:
        raise ValueError(f"unknown scoring mode: {mode}")
    if mode != "heuristic" and (model is None or not model.is_trained):
        raise ValueError(f"Mode {mode} needs a trained model")
    pages = parse_pages(usable_fetches(fetches), language=language, keep=keep)
    measured = extract_metrics(pages, lexicon=lexicon, citation_patterns=citation_patterns)
    if mode != "heuristic":
        measured = predict_scores(model, measured)
    if mode == "ml":
        return S.score_predicted(measured)
    scored = S.score_heuristic(measured, weights or Weights(), as_of)
    return S.score_hybrid(scored) if mode == "hybrid" else scored


def train_text_model(pages: DataFrame, labels: DataFrame, **options) -> Training:
    """Train the text model on the labelled ones among the given fetches or parsed pages.

    Fetches meet their labels before they are parsed, so only labelled pages are. Their texts
    are stored once, because training reads them several times.
    """
    if "text" in pages.columns:
        matched = match_labels(pages.select("url", "text", "fetched_at"), labels)
    else:
        labelled = match_labels(usable_fetches(pages), labels)
        matched = parse_pages(labelled, keep=["target_score"])
    shared_dir(pages.sparkSession)
    training = matched.select("url", "text", "target_score", "fetched_at").checkpoint()
    if training.isEmpty():
        raise ValueError("No pages matched with labels")
    return fit_classifier(training, key=("url", "fetched_at"), **options)


def calibrate_weights(
    fetches: DataFrame, labels: DataFrame, as_of: dt.datetime | str | Column, **options
) -> Calibration:
    """Evaluate the labelled fetches and learn the weights from them."""
    labelled = match_labels(usable_fetches(fetches), labels)
    return learn_weights(evaluate_pages(labelled, as_of, keep=["target_score"], **options))
