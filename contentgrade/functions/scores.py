"""Component scores, composite and quality class as column expressions."""

from __future__ import annotations

import datetime as dt
from dataclasses import asdict, astuple, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPONENTS = ("accuracy", "transparency", "completeness", "freshness", "clarity")

# Class names with their lower bounds, and the days until a date counts as old.
CLASSES = (("Eccellente", 85), ("Buono", 70), ("Discreto", 50))
LOWEST_CLASS = "Criticità"
DECAY_DAYS = 365


@dataclass(frozen=True)
class Weights:
    """Weights of the five components."""

    accuracy: float = 0.4
    transparency: float = 0.2
    completeness: float = 0.2
    freshness: float = 0.1
    clarity: float = 0.1

    def normalized(self) -> Weights:
        total = sum(astuple(self))
        if not total:
            raise ValueError("Weights sum to zero")
        return Weights(*[value / total for value in astuple(self)])

    def as_dict(self) -> dict[str, float]:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> Weights:
        """Missing names take their defaults, unknown ones are ignored."""
        return cls(**{name: float(values[name]) for name in COMPONENTS if name in values})

    def as_column(self) -> Column:
        return F.struct(*[F.lit(float(v)).alias(k) for k, v in asdict(self).items()])


def accuracy(numeric_tokens: Column, word_count: Column, has_formula: Column) -> Column:
    ratio = F.least(
        numeric_tokens.cast("double") / F.greatest(word_count, F.lit(1)).cast("double"), F.lit(0.2)
    )
    base = F.lit(60.0) + ratio * F.lit(200.0)
    bonus = F.when(has_formula, F.lit(10.0)).otherwise(F.lit(0.0))
    return F.when(numeric_tokens == 0, F.lit(40.0)).otherwise(F.least(base + bonus, F.lit(100.0)))


def transparency(citations: Column) -> Column:
    return F.when(citations == 0, F.lit(30.0)).otherwise(
        F.least((citations * 15 + 30).cast("double"), F.lit(100.0))
    )


def completeness(has_table: Column, has_list: Column, n_terms: Column) -> Column:
    points = (
        F.lit(40)
        + F.when(has_table, F.lit(20)).otherwise(F.lit(0))
        + F.when(has_list, F.lit(10)).otherwise(F.lit(0))
        + F.least(n_terms * 5, F.lit(30))
    )
    return F.least(points, F.lit(100)).cast("double")


_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_BASIC_DATE = r"\A([0-9]{4})([0-9]{2})([0-9]{2})(?=\D|\z)"
_CLOCK = r"[0-9]{2}(?::[0-9]{2}(?::[0-9]{2})?)?"
_FRACTION = r"[0-9]{2}:[0-9]{2}:[0-9]{2}[.,][0-9]+"
_ZONE = r"[+\-][0-9]{2}(?::?[0-9]{2}(?::[0-9]{2})?)?"
_BASIC_SECONDS = r"(?s)\A(.{11}[0-9]{2})([0-9]{2})([0-9]{2})(?![0-9:])"
_BASIC_MINUTES = r"(?s)\A(.{11}[0-9]{2})([0-9]{2})(?![0-9:])"


def iso_timestamp(text: Column) -> Column:
    """ISO 8601 text to a timestamp, null if it is none; without a zone it is read as UTC.

    Calendar dates in extended and basic form, any separator before the time; week dates are
    not read. Everything is brought to one layout first, because Spark's own cast accepts
    less and more than that.
    """
    extended = F.regexp_replace(F.replace(text, F.lit("Z"), F.lit("+00:00")), _BASIC_DATE, "$1-$2-$3")
    timed = F.regexp_replace(
        F.regexp_replace(extended, _BASIC_SECONDS, "$1:$2:$3"), _BASIC_MINUTES, "$1:$2"
    )
    valid = timed.rlike(
        rf"(?s)\A{_DATE}(?:.(?:{_CLOCK}(?: ?{_ZONE})?|{_FRACTION}(?:{_ZONE})?))?\z"
    )
    date = F.substr(timed, F.lit(1), F.lit(10))
    clock = F.regexp_extract(timed, rf"(?s)\A{_DATE}.({_FRACTION}|{_CLOCK})", 1)
    hms = F.regexp_extract(clock, r"\A[0-9:]+", 0)
    padded = F.concat(hms, F.substr(F.lit("00:00:00"), F.length(hms) + 1))
    fraction = F.regexp_extract(clock, r"[.,]([0-9]{1,6})", 1)
    zone = F.regexp_extract(timed, rf"(?s)\A{_DATE}.[0-9:.,]+ ?({_ZONE})\z", 1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    offset = F.when(zone == "", F.lit("+00:00")).otherwise(
        F.concat(
            F.substr(zone, F.lit(1), F.lit(1)),
            F.substr(digits, F.lit(1), F.lit(2)),
            F.lit(":"),
            F.rpad(F.substr(digits, F.lit(3), F.lit(2)), 2, "0"),
        )
    )
    layout = F.concat(date, F.lit("T"), padded, F.lit("."), F.rpad(fraction, 6, "0"), offset)
    seconds = F.coalesce(F.substr(digits, F.lit(5), F.lit(2)).try_cast("bigint"), F.lit(0))
    signed = F.when(F.startswith(zone, F.lit("-")), -seconds).otherwise(seconds)
    moment = layout.try_cast("timestamp")
    return F.when(valid, F.when(signed == 0, moment).otherwise(F.timestamp_micros(F.unix_micros(moment) - signed * 1000000)))


def as_of_column(as_of: dt.datetime | str | Column) -> Column:
    """The moment against which pages age. Always explicit, so that runs can be repeated."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=dt.timezone.utc)
    micros = (as_of - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros))


def freshness(moment: Column, parsed: Column, as_of: Column) -> Column:
    """Score of a date: 50 without one, 60 if unreadable, 80 if in the future.

    ``parsed`` is ``iso_timestamp(moment)``, best taken from an earlier projection.
    """
    days = F.floor((F.unix_micros(as_of) - F.unix_micros(parsed)).cast("double") / 86400000000.0)
    decay = F.least(days.cast("double") / float(DECAY_DAYS), F.lit(1.0))
    return (
        F.when(F.coalesce(moment, F.lit("")) == "", F.lit(50.0))
        .when(parsed.isNull(), F.lit(60.0))
        .when(days < 0, F.lit(80.0))
        .otherwise(F.greatest(F.lit(20.0), F.lit(100.0) * (F.lit(1.0) - decay)))
    )


def clarity(numeric_tokens: Column, word_count: Column) -> Column:
    density = numeric_tokens.cast("double") / F.nullif(word_count, F.lit(0)).cast("double")
    return (
        F.when(word_count == 0, F.lit(40.0)).when(density > 0.15, F.lit(65.0)).otherwise(F.lit(80.0))
    )


def relevant_date(metadata: Column) -> Column:
    """The modification date, or the publication date where that is missing or empty."""
    return F.coalesce(F.nullif(metadata["modified"], F.lit("")), metadata["published"])


def components(metrics: Column, moment: Column, parsed: Column, as_of: Column) -> Column:
    """All five component scores, unrounded, as one struct."""
    return F.struct(
        accuracy(metrics["numeric_tokens"], metrics["word_count"], metrics["has_formula"]).alias(
            "accuracy"
        ),
        transparency(metrics["citation_matches"]).alias("transparency"),
        completeness(
            metrics["has_table"], metrics["has_list"], F.size(F.map_keys(metrics["actuarial_terms"]))
        ).alias("completeness"),
        freshness(moment, parsed, as_of).alias("freshness"),
        clarity(metrics["numeric_tokens"], metrics["word_count"]).alias("clarity"),
    )


def normalize_weights(weights: Column) -> Column:
    """Weights divided by their sum; an error if that is zero."""
    total = weights["accuracy"]
    for name in COMPONENTS[1:]:
        total = total + weights[name]
    checked = F.when(total == 0, F.raise_error(F.lit("Weights sum to zero")).cast("double")).otherwise(
        total
    )
    return F.struct(*[(weights[name] / checked).alias(name) for name in COMPONENTS])


def weighted_sum(parts: Column, weights: Column) -> Column:
    """Composite of components under weights that are already normalised; missing counts as 0."""
    total = F.coalesce(parts["accuracy"], F.lit(0.0)) * weights["accuracy"]
    for name in COMPONENTS[1:]:
        total = total + F.coalesce(parts[name], F.lit(0.0)) * weights[name]
    return total


def classify(score: Column) -> Column:
    label = F.lit(LOWEST_CLASS)
    for name, bound in reversed(CLASSES):
        label = F.when(score >= bound, F.lit(name)).otherwise(label)
    return label
