"""Event study: what changes from the weeks before an event to the weeks after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newstide.functions.significance import t_p_value
from newstide.operators.asof import event_windows
from newstide.operators.windows import centered_mean, series

ALPHA = 0.05


def smoothed(values: DataFrame, entity: str = "entity", d: str = "d", cols=("score", "close", "n_items"), n: int = 7) -> DataFrame:
    """Centered full-window mean of each measure, per entity."""
    w = series([entity], d)
    return values.select(entity, d, *[centered_mean(c, n, w, n).alias(c) for c in cols])


def pooled_t(prefix: str = "") -> dict[str, F.Column]:
    """Pooled two-sample t (positive when pre > post) and its degrees of freedom from per-phase moments."""
    n1, n2 = F.col(f"{prefix}pre_n"), F.col(f"{prefix}post_n")
    df = n1 + n2 - 2
    pooled = F.try_divide(
        (n1 - 1) * F.coalesce(f"{prefix}pre_var", F.lit(0.0)) + (n2 - 1) * F.coalesce(f"{prefix}post_var", F.lit(0.0)), df
    )
    spread = F.sqrt(pooled * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    return {"t_statistic": F.try_divide(F.col(f"{prefix}pre_mean") - F.col(f"{prefix}post_mean"), spread), "t_df": df}


def window_stats(events: DataFrame, values: DataFrame, pre: int = 28, post: int = 28, entity: str = "entity", d: str = "d") -> DataFrame:
    """Per entity and event day: means of score, price and count before and after, and the score's moments."""
    rows = event_windows(events, values, pre, post, entity, d)

    def phase(fn, c: str, side: str):
        return fn(F.when(F.col("phase") == side, F.col(c)))

    return rows.groupBy(entity, "event_day").agg(
        *[phase(F.avg, "score", s).alias(f"{s}_mean") for s in ("pre", "post")],
        *[phase(F.var_samp, "score", s).alias(f"{s}_var") for s in ("pre", "post")],
        *[phase(F.count, "score", s).alias(f"{s}_n") for s in ("pre", "post")],
        *[phase(F.avg, "close", s).alias(f"{s}_price") for s in ("pre", "post")],
        *[phase(F.avg, "n_items", s).alias(f"{s}_items") for s in ("pre", "post")],
    )


def pooled_t_test(stats: DataFrame, p_value: bool = True) -> DataFrame:
    out = stats.withColumns(pooled_t())
    if not p_value:
        return out
    out = out.withColumn("p_value", t_p_value(F.col("t_statistic"), F.col("t_df")))
    return out.withColumn("significant", F.coalesce(F.col("p_value") < ALPHA, F.lit(False)))


def event_study(
    events: DataFrame,
    values: DataFrame,
    pre: int = 28,
    post: int = 28,
    entity: str = "entity",
    d: str = "d",
    p_value: bool = True,
) -> DataFrame:
    """One row per event. ``values`` is the (smoothed) daily series with ``score``, ``close`` and ``n_items``.

    Statistics are computed once per entity and event day and then attached to the events of that day. An event without
    any day of the series in its windows stays: no statistics, a sample size of 0 and not significant.
    """
    stats = pooled_t_test(window_stats(events, values, pre, post, entity, d), p_value)
    study = stats.withColumns(
        {
            "score_change": F.col("post_mean") - F.col("pre_mean"),
            "price_change_pct": 100.0 * (F.try_divide("post_price", "pre_price") - 1),
            "items_change": F.col("post_items") - F.col("pre_items"),
            "sample_size": F.col("pre_n") + F.col("post_n"),
        }
    )
    out = events.withColumnRenamed(d, "event_day").join(study, [entity, "event_day"], "left")
    out = out.withColumn("sample_size", F.coalesce("sample_size", F.lit(0)))
    return out.withColumn("significant", F.coalesce("significant", F.lit(False))) if p_value else out
