"""Daily series, chart data and the wide feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from newstide.functions.dates import calendar_columns
from newstide.functions.scores import finite
from newstide.operators.aggregates import daily_mean, daily_stats
from newstide.operators.asof import asof_price, event_distance, proximity_columns, with_event_reach
from newstide.operators.windows import (
    centered_mean,
    diff,
    fill_both,
    fill_forward,
    lag_filled,
    ma_cross,
    momentum,
    relative_to_mean,
    rolling_cv,
    rolling_pct_rank,
    rolling_std,
    series,
    trailing_mean,
    volume_columns,
    zscore_by,
)


def daily_series(items: DataFrame) -> DataFrame:
    """Daily statistics with trailing 7- and 30-row means, the base of forecasting."""
    w = series(["entity"])
    return daily_stats(items).withColumns(
        {
            "score_ma7": trailing_mean("score_mean", 7, w),
            "score_ma30": trailing_mean("score_mean", 30, w),
            "n_items_ma7": trailing_mean("n_items", 7, w),
        }
    )


def chart_series(items: DataFrame, price: DataFrame) -> DataFrame:
    """Per entity and day: price and the full 7-row mean of the daily score, both restarting each year."""
    score = daily_mean(items).withColumn("year", F.year("d"))
    score = score.withColumn("score_ma7", trailing_mean("score", 7, series(["entity", "year"]), 7))
    return (
        score.select("entity", "d", "score_ma7")
        .join(price.select("entity", "d", "close"), ["entity", "d"], "full")
        .withColumn("year", F.year("d"))
    )


def smoothed_price(price: DataFrame) -> DataFrame:
    """Centered 7-row mean of the close (at least 3 rows) inside each calendar year, over trading days."""
    w = series(["entity", "year"])
    return price.withColumn("year", F.year("d")).select("entity", "d", centered_mean("close", 7, w, 3).alias("close"))


def _entity_days() -> WindowSpec:
    """A series in order. With the year in the order one sort serves this window and those that restart each year."""
    return Window.partitionBy("entity").orderBy("_year", "d")


YEAR = ("entity", "_year")


def price_gaps(c: str = "price", forward: str = "_ff") -> dict[str, Column]:
    """Momentum, volatility, ranks and relations to means of a price; ``forward`` is the price filled forward."""
    w = _entity_days()
    return {
        "price_momentum_1": momentum(forward, 1, w),
        "price_momentum_2": momentum(forward, 2, w),
        "price_momentum_4": momentum(forward, 4, w),
        "price_std_2": rolling_std(c, 2, w),
        "price_std_3": rolling_std(c, 3, w, 2),
        "price_zscore": zscore_by(c, YEAR),
        "price_pct_rank_4": rolling_pct_rank(c, 4, w),
        "price_vs_year": relative_to_mean(c, YEAR),
        "price_vs_overall": relative_to_mean(c, ["entity"]),
    }


def score_gaps(c: str = "score") -> dict[str, Column]:
    """The same of a score, with its change and its variation."""
    w = _entity_days()
    return {
        "score_momentum_1": momentum(c, 1, w),
        "score_momentum_2": momentum(c, 2, w),
        "score_momentum_4": momentum(c, 4, w),
        "score_std_2": rolling_std(c, 2, w),
        "score_std_3": rolling_std(c, 3, w, 2),
        "score_zscore": zscore_by(c, YEAR),
        "score_diff": diff(c, w),
        "score_pct_rank_4": rolling_pct_rank(c, 4, w),
        "score_cv_4": rolling_cv(c, 4, w, 2),
        "score_vs_year": relative_to_mean(c, YEAR),
        "score_vs_overall": relative_to_mean(c, ["entity"]),
    }


def with_series_features(df: DataFrame) -> DataFrame:
    """Price, score and volume features of a table with entity, d, price, score and n_items, level by level.

    What does not depend on each other is one projection, so that Spark evaluates it in one window a level.
    """
    w = _entity_days()
    volume = volume_columns("n_items", w, ["entity"])
    df = df.withColumns({"_ff": fill_forward("price", w), **volume})
    gaps = {**price_gaps(), **score_gaps()}
    df = df.withColumns({**gaps, "price_ma_cross": ma_cross("price", w)})
    lags = {f"{c}_lag_{k}": lag_filled(c, k, w) for c, n in (("price", 2), ("score", 3)) for k in range(1, n + 1)}
    return df.withColumns({**{n: fill_both(n, w) for n in (*gaps, "volume_momentum", "price")}, **lags}).drop("_ff")


def event_features(df: DataFrame, events: DataFrame) -> DataFrame:
    df = event_distance(with_event_reach(df, events), events)
    return df.withColumns(proximity_columns(F.col("days_to_next"), F.col("days_since_last")))


def interactions(df: DataFrame) -> DataFrame:
    """Products and ratios across score, price, volume, calendar and events; non-finite values become NULL."""
    w = _entity_days()
    columns = {
        "score_price_ratio": finite(F.try_divide("score", "price")),
        "score_price_momentum": F.col("score") * F.col("price_momentum_1"),
        "items_score": F.col("n_items") * F.col("score"),
        "items_impact": F.col("n_items") * F.col("event_impact"),
        "quarter_impact": F.col("quarter") * F.col("event_impact"),
        "season_score": F.col("is_season") * F.col("score"),
        **{f"score_momentum_lag_{k}": lag_filled("score_momentum_1", k, w) for k in (1, 2)},
    }
    return df.withColumns(columns).withColumn("score_price_momentum_lag", lag_filled("score_price_momentum", 1, w))


def feature_table(items: DataFrame, price: DataFrame, events: DataFrame) -> DataFrame:
    """One wide row per entity and day with items: calendar, score, price, event, interaction and lag features.

    Articles, prices and events are first folded to days, and all ordered windows share the key (entity, year, day).
    """
    daily = daily_stats(items).select("entity", "d", "n_items", "score_mean")
    near = event_features(daily, events)  # joins on (entity, day) first, while rows still lie by entity and day
    table = asof_price(near, smoothed_price(price).withColumnRenamed("close", "price"), ["price"])
    table = table.withColumn("_year", F.year("d"))
    table = table.withColumn("score", centered_mean("score_mean", 7, Window.partitionBy(*YEAR).orderBy("d"), 3)).drop("score_mean")
    table = table.withColumns({"score": fill_both("score", _entity_days()), **calendar_columns(F.col("d"))})
    return interactions(with_series_features(table)).drop("_year")


FEATURE_GROUPS = {
    "calendar": ("year", "month", "quarter", "day_of", "week_of", "is_"),
    "score": ("score",),
    "price": ("price",),
    "event": ("event", "days_", "impact"),
    "volume": ("n_items", "volume", "items_"),
    "momentum": ("momentum",),
    "volatility": ("_std_", "_cv_"),
    "lag": ("lag",),
    "interaction": ("ratio", "_vs_", "price_momentum", "items_", "quarter_impact", "season_score"),
}
