"""Row-based window features of a daily series.

Call these on series already folded to one row per entity and day: a window partition is then bounded by the number of
days, however many items a hot entity has. Functions taking ``w`` return a Column over the ordered window ``w``;
functions taking a DataFrame add columns that need more than one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from newstide.functions.scores import total
from newstide.operators.sets import numbered_in_groups

START, END = Window.unboundedPreceding, Window.unboundedFollowing


def series(by: Sequence[str], d: str = "d") -> WindowSpec:
    """Ordered window of one series; extra keys (a year) restart it."""
    return Window.partitionBy(*by).orderBy(d)


def _framed(c: str, frame: WindowSpec, min_rows: int, value: Column) -> Column:
    out = value.over(frame)
    return out if min_rows <= 1 else F.when(F.count(c).over(frame) >= min_rows, out)


def trailing_mean(c: str, n: int, w: WindowSpec, min_rows: int = 1) -> Column:
    return _framed(c, w.rowsBetween(-(n - 1), 0), min_rows, F.avg(c))


def centered_mean(c: str, n: int, w: WindowSpec, min_rows: int = 1) -> Column:
    return _framed(c, w.rowsBetween(-(n // 2), n // 2), min_rows, F.avg(c))


def rolling_std(c: str, n: int, w: WindowSpec, min_rows: int | None = None) -> Column:
    """Sample deviation of the last ``n`` rows."""
    return _framed(c, w.rowsBetween(-(n - 1), 0), max(min_rows or n, 2), F.stddev_samp(c))


def rolling_cv(c: str, n: int, w: WindowSpec, min_rows: int | None = None) -> Column:
    return F.try_divide(rolling_std(c, n, w, min_rows), trailing_mean(c, n, w, min_rows or n))


def fill_forward(c: str, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(START, 0))


def fill_both(c: str, w: WindowSpec) -> Column:
    """Last known value, else (at the head only) the first one of the series.

    The whole-series frame is evaluated once per series; a frame from each row to the end would be once per row.
    """
    return F.coalesce(fill_forward(c, w), F.first(c, ignorenulls=True).over(w.rowsBetween(START, END)))


def lag_filled(c: str, k: int, w: WindowSpec) -> Column:
    """Value ``k`` rows back, gaps filled forward and the head from the series' first value."""
    return F.coalesce(
        F.last(c, ignorenulls=True).over(w.rowsBetween(START, -k)),
        F.first(c, ignorenulls=True).over(w.rowsBetween(START, END)),
    )


def diff(c: str, w: WindowSpec) -> Column:
    return F.col(c) - F.lag(c, 1).over(w)


def momentum(c: str, k: int, w: WindowSpec) -> Column:
    """Fractional change over ``k`` rows; NULL at the head and over a zero base."""
    return F.try_divide(F.col(c), F.lag(c, k).over(w)) - 1


def returns(c: str, w: WindowSpec) -> Column:
    return momentum(c, 1, w)


def rolling_pct_rank(c: str, n: int, w: WindowSpec) -> Column:
    """Average-tie rank of the current value among the last ``n`` rows, as a share of the values present."""
    now = F.col(c)
    window = [F.lag(c, k).over(w) for k in range(n)]

    def tally(test) -> Column:
        return total([F.when(test(v), 1.0).otherwise(0.0) for v in window])

    less, same, present = tally(lambda v: v < now), tally(lambda v: v == now), tally(lambda v: v.isNotNull())
    return F.when(now.isNotNull(), (less + (same + 1) / 2) / present)


def ma_cross(c: str, w: WindowSpec, short: int = 2, long: int = 4) -> Column:
    """1 while the short trailing mean is above the long one."""
    return F.coalesce((trailing_mean(c, short, w) > trailing_mean(c, long, w)).cast("int"), F.lit(0))


def zscore_by(c: str, by: Sequence[str]) -> Column:
    """Distance from the group mean in population deviations."""
    w = Window.partitionBy(*by)
    return F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w))


def relative_to_mean(c: str, by: Sequence[str]) -> Column:
    return F.try_divide(F.col(c), F.avg(c).over(Window.partitionBy(*by))) - 1


def group_stats(c: str, by: Sequence[str]) -> dict[str, Column]:
    """Mean and sample deviation of the row's group, on every row."""
    w = Window.partitionBy(*by)
    return {f"{c}_group_mean": F.avg(c).over(w), f"{c}_group_std": F.stddev_samp(c).over(w)}


def with_filled(df: DataFrame, columns: dict[str, Column], w: WindowSpec) -> DataFrame:
    """Add columns and fill their gaps forward, then their heads backward."""
    return df.withColumns(columns).withColumns({name: fill_both(name, w) for name in columns})


def volume_columns(count: str, w: WindowSpec, by: Sequence[str], q: float = 0.9) -> dict[str, Column]:
    """One-row change of the count, and 1 where it exceeds the entity's ``q`` quantile (of its days)."""
    cut = F.percentile(count, q).over(Window.partitionBy(*by))
    return {"volume_momentum": momentum(count, 1, w), "volume_spike": (F.col(count) > cut).cast("int")}


def volume_features(df: DataFrame, count: str, by: Sequence[str], d: str = "d", q: float = 0.9) -> DataFrame:
    return df.withColumns(volume_columns(count, series(by, d), by, q))


def risk_ratios(df: DataFrame, price: str, by: Sequence[str], d: str = "d", periods: int = 252) -> DataFrame:
    """Maximum drawdown and yearly Sharpe, information (against the all-entity mean return of the day) and Calmar."""
    w = series(by, d)
    path = df.withColumns(
        {
            "ret": returns(price, w),
            "drop": F.col(price) / F.max(price).over(w.rowsBetween(START, 0)) - 1,
        }
    )
    market = path.groupBy(d).agg(F.avg("ret").alias("market"))
    scale = float(periods) ** 0.5
    return (
        path.join(market, d)
        .groupBy(*by)
        .agg(
            F.min("drop").alias("max_drawdown"),
            (F.avg("ret") * periods).alias("annual_return"),
            (F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * scale).alias("sharpe"),
            (
                F.try_divide(F.avg(F.col("ret") - F.col("market")), F.stddev_samp(F.col("ret") - F.col("market")))
                * scale
            ).alias("information_ratio"),
        )
        .withColumn("calmar", F.try_divide("annual_return", F.abs("max_drawdown")))
    )


def event_lanes(events: DataFrame, by: Sequence[str], d: str = "d", order: str = "event_id", gap: int = 15) -> DataFrame:
    """Label lane of each event: 0, or one above the lane last used on that date if the event before it is close.

    Only the first event of a date can have its predecessor on an earlier day; each further one of that date climbs by
    one. The previous date is looked up among the distinct dates, and a date with very many events is numbered in ranges.
    """
    days = events.select(*by, d).distinct()
    near = F.datediff(d, F.lag(d).over(Window.partitionBy(*by).orderBy(d))) < gap
    days = days.select(*by, d, F.coalesce(near, F.lit(False)).cast("int").alias("near"))
    return (
        numbered_in_groups(events, [*by, d], order, "_place")
        .join(days, [*by, d])
        .withColumn("lane", (F.col("_place") - 1 + F.col("near")).cast("int"))
        .drop("near", "_place")
    )
