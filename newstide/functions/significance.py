"""Two-sided Student-t tail as a vectorised function of already aggregated rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TINY, STEPS, TOLERANCE = 1e-300, 500, 1e-15


def beta_regularized(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz method)."""
    flip = x > (a + 1.0) / (a + b + 2.0)
    x, a, b = np.where(flip, 1.0 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a

    def guard(v: np.ndarray) -> np.ndarray:
        return np.where(np.abs(v) < TINY, TINY, v)

    c = np.ones_like(x)
    d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    f = d
    for m in range(1, STEPS):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1.0 / guard(1.0 + even * d), guard(1.0 + even / c)
        f = f * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1.0 / guard(1.0 + odd * d), guard(1.0 + odd / c)
        step = d * c
        f = f * step
        if np.all(np.abs(step - 1.0) < TOLERANCE):
            break
    value = np.where(x <= 0.0, 0.0, front * f)
    return np.where(flip, 1.0 - value, value)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    good = np.isfinite(t) & np.isfinite(df) & (df > 0)
    out = np.full(t.shape, np.nan)
    if good.any():
        v = df[good]
        out[good] = beta_regularized(v / (v + t[good] ** 2), v / 2.0, np.full(v.shape, 0.5))
    return out


@F.pandas_udf(T.DoubleType())
def _t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    p = t_two_sided(t.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan))
    return pd.Series(p).where(np.isfinite(p), None)


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p; use on summary rows only (one row per test)."""
    return _t_tail(t.cast("double"), df.cast("double"))


def corr_p_value(r: Column, n: Column) -> Column:
    return t_p_value(F.try_divide(r * F.sqrt(F.greatest(n - 2, F.lit(0))), F.sqrt(1 - r * r)), n - 2)


def bonferroni(p: Column, m: Column | int) -> Column:
    return F.least(p * m, F.lit(1.0))
