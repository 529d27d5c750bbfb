"""Min-max and robust scaling from grouped statistics, and their inverse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newstide.operators.quantiles import exact_percentiles


def minmax_bounds(df: DataFrame, cols: Sequence[str], by: Sequence[str], fit: Column | None = None) -> DataFrame:
    """Lowest and highest value per group, over the rows where ``fit`` holds (all rows by default)."""
    use = F.lit(True) if fit is None else fit
    return df.groupBy(*by).agg(
        *[F.min(F.when(use, F.col(c))).alias(f"{c}_lo") for c in cols],
        *[F.max(F.when(use, F.col(c))).alias(f"{c}_hi") for c in cols],
    )


def _span(c: str) -> Column:
    width = F.col(f"{c}_hi") - F.col(f"{c}_lo")
    return F.when(width == 0, F.lit(1.0)).otherwise(width)


def minmax(df: DataFrame, bounds: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Map each column to [0, 1] of its group's bounds; a constant column has span 1."""
    out = df.join(bounds, list(by)).withColumns({c: (F.col(c) - F.col(f"{c}_lo")) / _span(c) for c in cols})
    return out.drop(*[f"{c}_{e}" for c in cols for e in ("lo", "hi")])


def unscale(df: DataFrame, bounds: DataFrame, scaled: str, c: str, by: Sequence[str]) -> DataFrame:
    """Bring ``scaled`` back to the units of column ``c``."""
    edges = bounds.select(*by, f"{c}_lo", f"{c}_hi")
    return df.join(edges, list(by)).withColumn(scaled, F.col(scaled) * _span(c) + F.col(f"{c}_lo")).drop(f"{c}_lo", f"{c}_hi")


def robust_scale(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(v - median) / IQR per group; an IQR of 0 counts as 1."""
    q = exact_percentiles(df, by, cols, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    wide = q.groupBy(*by).agg(
        *[F.max(F.when(F.col("column") == c, F.struct("q1", "q2", "q3"))).alias(f"_{c}") for c in cols]
    )

    def scaled(c: str) -> Column:
        iqr = F.col(f"_{c}.q3") - F.col(f"_{c}.q1")
        return (F.col(c) - F.col(f"_{c}.q2")) / F.when(iqr == 0, F.lit(1.0)).otherwise(iqr)

    return df.join(wide, list(by), "left").withColumns({c: scaled(c) for c in cols}).drop(*[f"_{c}" for c in cols])
