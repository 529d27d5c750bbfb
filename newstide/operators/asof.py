"""Joins of a daily spine with prices and event calendars: equi, as-of, interval and event windows.

Interval conditions are turned into equi joins on (entity, day): the event side is folded to one row per entity and day,
then fanned out to the days it touches. Its size depends on the calendar, not on the number of events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newstide.operators.windows import START, fill_both, series


def join_daily(spine: DataFrame, price: DataFrame, how: str = "left", keys: Sequence[str] = ("entity", "d")) -> DataFrame:
    return spine.join(price, list(keys), how)


def asof_price(
    spine: DataFrame,
    price: DataFrame,
    cols: Sequence[str] = ("close",),
    entity: str = "entity",
    d: str = "d",
    within: str | None = "year",
) -> DataFrame:
    """Last price on or before each spine day; ``within='year'`` never reaches back over New Year's Day.

    Both sides are stacked and filled along one window, so price days missing from the spine count too. They are
    distributed by entity alone, which serves the yearly window here and every later window of the entity.
    """
    keys = [entity, *(["_year"] if within == "year" else [])]
    extra = [c for c in spine.columns if c not in (entity, d)]
    left = spine.select(entity, d, F.lit(1).alias("_side"), F.struct(*extra).alias("_row") if extra else F.lit(None).alias("_row"))
    right = price.select(entity, d, F.lit(0).alias("_side"), *cols)
    both = left.unionByName(right, allowMissingColumns=True).repartition(entity).withColumn("_year", F.year(d))
    w = Window.partitionBy(*keys).orderBy(d, "_side").rowsBetween(START, 0)
    filled = both.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols}).where(F.col("_side") == 1)
    return filled.select(entity, d, *([f"_row.{c}" for c in extra] if extra else []), *cols)


def filled_price(df: DataFrame, cols: Sequence[str], entity: str = "entity", d: str = "d") -> DataFrame:
    """Close remaining gaps over the whole series: forward, then backward at its head."""
    w = series([entity], d)
    return df.withColumns({c: fill_both(c, w) for c in cols})


def _event_days(events: DataFrame, entity: str, d: str) -> DataFrame:
    return events.where(F.col(d).isNotNull()).groupBy(entity, d).agg(F.count(F.lit(1)).alias("_events"))


def event_distance(
    df: DataFrame, events: DataFrame, cap: int = 365, entity: str = "entity", d: str = "d"
) -> DataFrame:
    """``days_to_next`` (strictly later event) and ``days_since_last`` (on or before); ``cap`` where there is none.

    ``df`` has one row per entity and day. The later event is looked up on the series in reverse, again with a frame
    that only grows.
    """
    days = _event_days(events, entity, d).select(entity, d, F.col(d).alias("_event"))
    marks = df.withColumn("_row", F.lit(True)).join(days, [entity, d], "full")
    last = F.last("_event", ignorenulls=True).over(series([entity], d).rowsBetween(START, 0))
    back = Window.partitionBy(entity).orderBy(F.col(d).desc()).rowsBetween(START, -1)
    following = F.last("_event", ignorenulls=True).over(back)
    return (
        marks.withColumns(
            {
                "days_to_next": F.coalesce(F.datediff(following, d), F.lit(cap)),
                "days_since_last": F.coalesce(F.datediff(d, last), F.lit(cap)),
            }
        )
        .where("_row")
        .drop("_row", "_event")
    )


def event_reach(events: DataFrame, days: int = 60, tau: float = 30.0, entity: str = "entity", d: str = "d") -> DataFrame:
    """Per entity and day: events within ``days`` either side and the sum of exp(-distance/tau) over them."""
    gap = F.explode(F.sequence(F.lit(-days), F.lit(days))).alias("_gap")
    return (
        _event_days(events, entity, d)
        .select(entity, d, "_events", gap)
        .groupBy(entity, F.date_add(d, F.col("_gap")).alias(d))
        .agg(
            F.sum("_events").alias("events_nearby"),
            F.sum(F.col("_events") * F.exp(-F.abs("_gap") / tau)).alias("event_impact"),
        )
    )


def with_event_reach(
    df: DataFrame, events: DataFrame, days: int = 60, tau: float = 30.0, entity: str = "entity", d: str = "d"
) -> DataFrame:
    return df.join(event_reach(events, days, tau, entity, d), [entity, d], "left").withColumns(
        {
            "events_nearby": F.coalesce("events_nearby", F.lit(0)).cast("long"),
            "event_impact": F.coalesce("event_impact", F.lit(0.0)),
        }
    )


def proximity_columns(to_next: Column, since: Column, days: int = 30) -> dict[str, Column]:
    return {
        "event_proximity": 1.0 / (1.0 + F.least(to_next, since)),
        "pre_event": (to_next <= days).cast("int"),
        "post_event": (since <= days).cast("int"),
    }


def event_windows(
    events: DataFrame, values: DataFrame, pre: int = 28, post: int = 28, entity: str = "entity", d: str = "d"
) -> DataFrame:
    """Series rows around each event day: ``event_day``, ``phase`` pre = [e-pre, e) or post = [e, e+post].

    One row per distinct event day and series day; attach the events themselves by (entity, event_day).
    """
    offsets = F.explode(F.sequence(F.lit(-pre), F.lit(post))).alias("_gap")
    return (
        _event_days(events, entity, d)
        .select(entity, F.col(d).alias("event_day"), offsets)
        .select(
            entity,
            "event_day",
            F.date_add("event_day", F.col("_gap")).alias(d),
            F.when(F.col("_gap") < 0, "pre").otherwise("post").alias("phase"),
        )
        .join(values, [entity, d])
    )


def lag_join(
    a: DataFrame, b: DataFrame, max_lag: int = 21, entity: str = "entity", d: str = "d"
) -> DataFrame:
    """Rows of ``a`` next to the row of ``b`` ``lag`` calendar days later, for every lag from -max_lag to max_lag."""
    fan = F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")
    moved = a.select("*", fan).withColumn(d, F.date_add(d, F.col("lag")))
    return moved.join(b, [entity, d])


def align_predictions(pred: DataFrame, actual: DataFrame, keys: Sequence[str] = ("entity", "d")) -> DataFrame:
    """Predictions with their actuals by key, never by position."""
    return pred.join(actual, list(keys))
