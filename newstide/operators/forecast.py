"""Forecasters on lagged windows: closed-form AR(1), least squares from sufficient statistics, boosted trees (see ``trees``)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newstide.functions.text import let
from newstide.operators.blocks import block_sums
from newstide.operators.sets import last_rows
from newstide.operators.windows import START, series


def fit_ar1(daily: DataFrame, value: str, by: Sequence[str] = ("entity",), d: str = "d") -> DataFrame:
    """y[t] = intercept + slope * y[t-1] per series, by regression aggregates."""
    prev = F.lag(value).over(series(by, d))
    return (
        daily.select(*by, F.col(value).alias("_y"), prev.alias("_x"))
        .groupBy(*by)
        .agg(F.regr_intercept("_y", "_x").alias("intercept"), F.regr_slope("_y", "_x").alias("slope"))
    )


def ar1_predictions(daily: DataFrame, model: DataFrame, value: str, by: Sequence[str] = ("entity",), d: str = "d") -> DataFrame:
    prev = F.lag(value).over(series(by, d))
    return (
        daily.select(*by, d, F.col(value).alias("actual"), prev.alias("_x"))
        .where(F.col("_x").isNotNull())
        .join(model, list(by))
        .select(*by, d, "actual", (F.col("intercept") + F.col("slope") * F.col("_x")).alias("predicted"))
    )


def forecast_ar1(last: DataFrame, model: DataFrame, value: str, horizon: int, by: Sequence[str] = ("entity",), d: str = "d") -> DataFrame:
    """Recursive forecast of ``horizon`` days from the latest value, folded inside one expression per series."""
    path = F.aggregate(
        F.sequence(F.lit(1), F.lit(horizon)),
        F.struct(F.col(value).cast("double").alias("y"), F.array().cast("array<double>").alias("path")),
        lambda s, _: F.struct(
            (F.col("intercept") + F.col("slope") * s["y"]).alias("y"),
            F.concat(s["path"], F.array(F.col("intercept") + F.col("slope") * s["y"])).alias("path"),
        ),
    )["path"]
    return (
        last.join(model, list(by))
        .select(*by, d, F.posexplode(path).alias("step", "predicted"))
        .select(*by, F.date_add(d, F.col("step") + 1).alias(d), (F.col("step") + 1).alias("step"), "predicted")
    )


def _design(seq: DataFrame, by: Sequence[str], d: str) -> DataFrame:
    return seq.select(*by, d, "y", F.concat(F.array(F.lit(1.0)), F.flatten("x")).alias("z"))


def fit_linear(
    seq: DataFrame, by: Sequence[str] = ("entity",), d: str = "d", ridge: float = 1e-8
) -> DataFrame:
    """Least-squares weights (intercept first) per series on flattened input windows.

    The sums of z z' and z y are added up by Arrow batch (``blocks.block_sums``); the small normal equations, one row per
    series, are solved at the end.
    """
    design = _design(seq, by, d)
    sums = block_sums(design, F.concat("z", F.array("y")), by)
    packed = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "j", "sij"))).alias("cells"))
    packed = packed.select(*by, F.transform("cells", lambda c: c["sij"]).alias("m"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(m: pd.Series) -> pd.Series:
        out = []
        for upper in m:
            size = int((np.sqrt(8 * len(upper) + 1) - 1) / 2)
            whole = np.zeros((size, size))
            whole[np.triu_indices(size)] = upper
            gram = (whole + np.triu(whole, 1).T)[:-1, :-1] + ridge * np.eye(size - 1)
            out.append(np.linalg.lstsq(gram, whole[:-1, -1], rcond=None)[0].tolist())
        return pd.Series(out)

    return packed.select(*by, solve("m").alias("weights"))


def linear_predictions(seq: DataFrame, model: DataFrame, by: Sequence[str] = ("entity",), d: str = "d") -> DataFrame:
    products = F.zip_with("z", "weights", lambda a, b: a * b)
    return _design(seq, by, d).join(model, list(by)).select(
        *by, d, F.col("y").alias("actual"), F.aggregate(products, F.lit(0.0), lambda s, v: s + v).alias("predicted")
    )


def last_window(daily: DataFrame, features: Sequence[str], length: int, by: Sequence[str] = ("entity",), d: str = "d") -> DataFrame:
    """The latest ``length`` rows of each series as a window, oldest first, with their last date."""
    rows = F.struct(d, F.array(*[F.col(f).cast("double") for f in features]).alias("v"))
    return (
        last_rows(daily, length, by, d)
        .groupBy(*by)
        .agg(F.transform(F.array_sort(F.collect_list(rows)), lambda r: r["v"]).alias("x"), F.max(d).alias(d))
        .where(F.size("x") == length)
    )


def forecast_window(window: DataFrame, predict: Callable[[Column], Column], horizon: int, by: Sequence[str] = ("entity",), d: str = "d") -> DataFrame:
    """Recursive forecast: predict, copy the newest row with the prediction as feature 0, roll the window.

    ``predict`` turns a window (an array of rows, oldest first) into a value and may use other columns of ``window``. The
    recursion is a fold over 1..horizon inside the row of each series; no driver loop, no Python.
    """

    def step(s, _):
        newest = F.element_at(s["x"], -1)
        return let(
            predict(s["x"]),
            lambda y: F.struct(
                F.concat(F.slice(s["x"], 2, F.size(s["x"]) - 1), F.array(F.concat(F.array(y), F.slice(newest, 2, F.size(newest))))).alias("x"),
                F.concat(s["path"], F.array(y)).alias("path"),
            ),
        )

    start = F.struct(F.col("x").alias("x"), F.array().cast("array<double>").alias("path"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step)["path"]
    return window.select(*by, d, F.posexplode(path).alias("step", "predicted")).select(
        *by, F.date_add(d, F.col("step") + 1).alias(d), (F.col("step") + 1).alias("step"), "predicted"
    )


def forecast_linear(window: DataFrame, model: DataFrame, horizon: int, by: Sequence[str] = ("entity",), d: str = "d") -> DataFrame:
    """The recursive forecast of least squares."""

    def predict(x: Column) -> Column:
        z = F.concat(F.array(F.lit(1.0)), F.flatten(x))
        return F.aggregate(F.zip_with(z, F.col("weights"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    return forecast_window(window.join(model, list(by)), predict, horizon, by, d)


def rolling_ar1(daily: DataFrame, value: str, horizon: int = 1, least: int = 30, by: Sequence[str] = ("entity",), d: str = "d") -> DataFrame:
    """The forecast that each past day would have got for ``horizon`` rows later: adds n_pairs and ``predicted``.

    The line through (yesterday, today) is fitted on all pairs up to the day itself, from the running sums of a window that
    only grows, so a series costs one sorted pass. Before ``least`` pairs there is no forecast.
    """
    w = series(by, d)
    known = w.rowsBetween(START, 0)
    pairs = daily.withColumn("_x", F.lag(value).over(w))
    fitted = pairs.withColumns(
        {
            "_a": F.regr_intercept(value, "_x").over(known),
            "_b": F.regr_slope(value, "_x").over(known),
            "n_pairs": F.regr_count(value, "_x").over(known),
        }
    )
    ahead = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col(value).cast("double"), lambda y, _: F.col("_a") + F.col("_b") * y)
    return fitted.withColumn("predicted", F.when(F.col("n_pairs") >= least, ahead)).drop("_x", "_a", "_b")


def fit_trees(train: DataFrame, features: str = "x", **params):
    """Gradient-boosted trees over the pooled windows of all series."""
    data = train.select(array_to_vector(F.flatten(features)).alias("features"), F.col("y").alias("label"))
    return GBTRegressor(featuresCol="features", labelCol="label", seed=7, **{"maxIter": 10, "maxDepth": 4, **params}).fit(data)


def tree_predictions(seq: DataFrame, model, by: Sequence[str] = ("entity",), d: str = "d") -> DataFrame:
    data = seq.withColumn("features", array_to_vector(F.flatten("x")))
    return model.transform(data).select(*by, d, F.col("y").alias("actual"), F.col("prediction").alias("predicted"))


def forecast_summary(fc: DataFrame, last: DataFrame, value: str, by: Sequence[str] = ("entity",)) -> DataFrame:
    """Current value, moments of the forecast and the change between current value and mean forecast."""
    stats = fc.groupBy(*by).agg(
        F.avg("predicted").alias("forecast_mean"),
        F.min("predicted").alias("forecast_min"),
        F.max("predicted").alias("forecast_max"),
        F.stddev_samp("predicted").alias("forecast_std"),
    )
    return stats.join(last.select(*by, F.col(value).alias("current")), list(by)).withColumn(
        "change", F.col("forecast_mean") - F.col("current")
    )
