"""Sentiment scores on the 1..5 scale, grades and small projections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newstide.functions.text import let

LABELS = ("positive", "neutral", "negative")
LOW, MIDDLE, HIGH = 1.0, 3.0, 5.0


def clamp(c: Column, low: float = LOW, high: float = HIGH) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def _prob(probs: Column, label: str) -> Column:
    return F.coalesce(F.try_element_at(probs, F.lit(label)), F.lit(0.0))


def score_diff(probs: Column) -> Column:
    """3 + 2(positive - negative), clamped; a missing class counts 0."""
    return clamp(MIDDLE + 2.0 * (_prob(probs, "positive") - _prob(probs, "negative")))


def score_weighted(probs: Column) -> Column:
    """1, 3 and 5 weighted by the class probabilities, clamped."""
    return clamp(
        LOW * _prob(probs, "negative") + MIDDLE * _prob(probs, "neutral") + HIGH * _prob(probs, "positive")
    )


def score_single(label: Column, confidence: Column) -> Column:
    """Score from one label and its confidence."""
    side = F.when(label == "positive", 1.0).when(label == "negative", -1.0).otherwise(0.0)
    return clamp(MIDDLE + 2.0 * side * F.coalesce(confidence, F.lit(0.0)))


def argmax_label(probs: Column) -> Column:
    """Most probable label; the first one of the map on a tie."""
    ranked = F.transform(
        F.map_entries(probs), lambda e, i: F.struct(e["value"].alias("p"), (-i).alias("i"), e["key"].alias("label"))
    )
    return F.array_max(ranked)["label"]


def neutral_default(score: Column, label: Column) -> tuple[Column, Column]:
    """Failed scoring gives the neutral middle."""
    bad = score.isNull() | F.isnan(score) | label.isNull()
    return F.when(bad, F.lit(MIDDLE)).otherwise(score), F.when(bad, F.lit("neutral")).otherwise(label)


def finite(c: Column) -> Column:
    """NaN and infinity become NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def with_band(df: DataFrame, col: str, width: float = 0.2) -> DataFrame:
    return df.withColumns({"band_low": F.col(col) - width, "band_high": F.col(col) + width})


# Lower bounds of the five quality grades of an R2.
GRADES = ((0.8, "very good"), (0.6, "good"), (0.4, "fair"), (0.2, "ordinary"))


def grade(r2: Column, grades: Sequence[tuple[float, str]] = GRADES, otherwise: str = "needs work") -> Column:
    return F.coalesce(*[F.when(r2 > bound, F.lit(name)) for bound, name in grades], F.lit(otherwise))


def outlook(delta: Column, eps: float = 0.1) -> Column:
    return F.when(delta > eps, "improve").when(delta < -eps, "worsen").otherwise("stable")


def lexicon_probs(words: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """Class probabilities from word counts: the built-in deterministic scorer.

    ``words`` is the whole token array. With p and n listed words, positive = p/(p+n+1), negative = n/(p+n+1) and
    neutral takes the rest.
    """

    def count(ws: Column, listed: Sequence[str]) -> Column:
        return F.size(F.filter(ws, lambda w: w.isin(*listed))).cast("double")

    def shares(c: Column) -> Column:
        p, n = c["p"], c["n"]
        return F.create_map(
            F.lit("positive"), p / (p + n + 1.0), F.lit("neutral"), 1.0 / (p + n + 1.0), F.lit("negative"), n / (p + n + 1.0)
        )

    counts = let(words, lambda ws: F.struct(count(ws, positive).alias("p"), count(ws, negative).alias("n")))
    return let(counts, shares)


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
