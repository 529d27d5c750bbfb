"""The analysis report as one tidy table: section, entity, metric, value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newstide.operators import aggregates as A
from newstide.operators import evaluate as E
from newstide.operators import forecast as P
from newstide.operators.sets import latest
from newstide.operators.skew import stored


def tidy(df: DataFrame, section: str, entity: str | None, metrics: dict[str, str]) -> DataFrame:
    """One row per entity and metric; ``metrics`` maps the metric's name to its column."""
    cells = F.array(
        *[F.struct(F.lit(name).alias("metric"), F.col(c).cast("double").alias("value")) for name, c in metrics.items()]
    )
    who = F.col(entity) if entity else F.lit(A.ALL)
    return df.select(F.lit(section).alias("section"), who.alias("entity"), F.explode(cells).alias("c")).select(
        "section", "entity", "c.metric", "c.value"
    )


def analysis_report(items: DataFrame, predictions: DataFrame, horizon: int = 30) -> DataFrame:
    """Overview, label shares, entity comparison, model quality, yearly trend, volatility and outlook together.

    The items are read once: all sections but the model's come from the table that ``fold_items`` writes.
    """
    folded = A.fold_items(items)
    dated = folded.where(F.col("d").isNotNull())
    daily = stored(A.merged(dated, "entity", "d").select("entity", "d", F.col("mean_score").alias("score")), "daily")
    last = latest(daily, "score", ["entity"])
    path = P.forecast_ar1(last, P.fit_ar1(daily, "score"), "score", horizon)
    yearly = A.merged(folded, "entity", F.year("d").alias("year"))
    monthly = A.merged(folded, "entity", F.trunc("d", "MM").alias("month")).groupBy("entity").agg(F.avg("std_score").alias("volatility"))
    parts = [
        tidy(A.merged(folded), "overview", None, {"n": "n", "mean_score": "mean_score", "std_score": "std_score"}),
        tidy(A.label_shares(folded), "labels", "label", {"n": "n", "pct": "pct"}),
        tidy(
            A.compared(folded),
            "entities",
            "entity",
            {c: c for c in ("n", "share_pct", "mean_score", "std_score", "positive_ratio", "negative_ratio")},
        ),
        tidy(E.regression_metrics(predictions, ["entity"]), "model", "entity", {"mse": "mse", "mae": "mae", "r2": "r2"}),
        tidy(A.trend(yearly, ["entity"]), "trend", "entity", {"first": "first_mean", "last": "last_mean", "size": "magnitude"}),
        tidy(monthly, "volatility", "entity", {"monthly": "volatility"}),
        tidy(P.forecast_summary(path, last, "score"), "outlook", "entity", {"current": "current", "mean": "forecast_mean", "change": "change"}),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
