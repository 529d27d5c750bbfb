"""Signed lead/lag correlation of two daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newstide.operators.windows import returns, series


def lag_correlation(
    df: DataFrame, x: str, y: str, by: Sequence[str] = ("entity",), max_lag: int = 21, d: str = "d"
) -> DataFrame:
    """corr(x[t-lag], y[t]) and the same against the one-row return of ``y``; a positive lag means ``x`` leads.

    One window pass shifts ``x`` to every lag; the shifts are fanned out and folded map-side per group and lag.
    """
    w = series(by, d)
    lags = range(-max_lag, max_lag + 1)
    base = df.withColumn("_return", returns(y, w))
    cells = F.array(*[F.struct(F.lit(k).alias("lag_days"), F.lag(x, k).over(w).alias("x")) for k in lags])
    return (
        base.select(*by, F.col(y).alias("_y"), "_return", cells.alias("_cells"))
        .select(*by, "_y", "_return", F.explode("_cells").alias("_c"))
        .groupBy(*by, F.col("_c.lag_days").alias("lag_days"))
        .agg(F.corr("_c.x", "_y").alias("correlation_price"), F.corr("_c.x", "_return").alias("correlation_return"))
    )


def best_lag(table: DataFrame, by: Sequence[str] = ("entity",), col: str = "correlation_price") -> DataFrame:
    """Lag with the largest absolute correlation; ties go to the smaller distance, then to the negative side."""
    rank = F.struct(F.round(F.abs(col), 12), -F.abs("lag_days"), -F.col("lag_days"))
    return (
        table.where(F.col(col).isNotNull() & ~F.isnan(col))
        .groupBy(*by)
        .agg(F.max_by(F.struct("lag_days", F.col(col).alias("max_correlation")), rank).alias("best"))
        .select(*by, "best.*")
    )
