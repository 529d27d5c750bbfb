"""Scoring text with a pluggable model, loaded once per Python worker and called on whole Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newstide.functions import scores
from newstide.functions.text import tokens

Scorer = Callable[[list[str]], list[dict[str, float] | None]]
PROBS = T.MapType(T.StringType(), T.DoubleType())


def score_texts(df: DataFrame, text: str, load: Callable[[], Scorer], batch: int = 32, limit: int | None = None) -> DataFrame:
    """Add ``probs`` from ``load()``, a function that returns the scorer, and ``score_error``.

    A text is cut to ``limit`` characters, as much as the model takes. A batch that fails, or gets another number of
    results than texts, has NULL probabilities and says why in ``score_error``.
    """
    kind = T.StructType([T.StructField("probs", PROBS), T.StructField("error", T.StringType())])

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for part in parts:
            out: list = []
            errors: list = []
            for start in range(0, len(part), batch):
                chunk = [t[:limit] for t in part.iloc[start : start + batch].fillna("")]
                try:
                    found, error = list(scorer(chunk)), None
                    if len(found) != len(chunk):
                        raise ValueError(f"{len(found)} results for {len(chunk)} texts")
                except Exception as e:  # noqa: BLE001 - a model failure must not end the job
                    found, error = [None] * len(chunk), f"{type(e).__name__}: {e}"
                out.extend(found)
                errors.extend([error] * len(chunk))
            yield pd.DataFrame({"probs": pd.Series(out, dtype=object), "error": pd.Series(errors, dtype=object)})

    return df.withColumn("_scored", run(F.col(text))).withColumns({"probs": F.col("_scored.probs"), "score_error": F.col("_scored.error")}).drop("_scored")


def with_sentiment(df: DataFrame, probs: str = "probs", weighted: bool = True) -> DataFrame:
    """``score`` and ``label`` from class probabilities, neutral where scoring failed."""
    raw = scores.score_weighted(F.col(probs)) if weighted else scores.score_diff(F.col(probs))
    raw = F.when(F.size(F.coalesce(probs, F.create_map().cast("map<string,double>"))) > 0, raw)
    score, label = scores.neutral_default(raw, scores.argmax_label(F.col(probs)))
    return df.withColumns({"score": score, "label": label})


def score_lexicon(df: DataFrame, text: str, positive: Sequence[str], negative: Sequence[str]) -> DataFrame:
    """The default scorer: word counts as native expressions over the whole text."""
    return with_sentiment(df.withColumn("probs", scores.lexicon_probs(tokens(text), positive, negative)))
