"""Quality of predictions: regression, direction and threshold measures, leaderboards, drift, best epochs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newstide.operators.windows import START, series


def with_errors(pred: DataFrame) -> DataFrame:
    error = F.col("predicted") - F.col("actual")
    return pred.withColumns({"error": error, "abs_error": F.abs(error)})


def metric_columns() -> dict[str, F.Column]:
    """MSE, MAE, RMSE, R2 and MAPE (a fraction) over rows with ``actual`` and ``predicted``.

    The total sum of squares is n * var_pop, which Spark accumulates around the running mean, so a large level of the
    series does not cancel.
    """
    a, e = F.col("actual"), F.col("predicted") - F.col("actual")
    mse = F.avg(e * e)
    return {
        "n": F.count(e),
        "mse": mse,
        "mae": F.avg(F.abs(e)),
        "rmse": F.sqrt(mse),
        "r2": 1 - F.try_divide(mse, F.var_pop(F.when(e.isNotNull(), a))),
        "mape": F.avg(F.abs(F.try_divide(e, a))),
    }


def regression_metrics(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return pred.groupBy(*by).agg(*[c.alias(n) for n, c in metric_columns().items()])


def direction_accuracy(pred: DataFrame, by: Sequence[str] = ("entity",), d: str = "d") -> DataFrame:
    """Percentage of steps on which actual and predicted move to the same side."""
    w = series(by, d)
    a = F.signum(F.col("actual") - F.lag("actual").over(w))
    p = F.signum(F.col("predicted") - F.lag("predicted").over(w))
    return pred.select(*by, (a == p).alias("hit")).groupBy(*by).agg(
        (100.0 * F.avg(F.col("hit").cast("double"))).alias("direction_pct"), F.count("hit").alias("steps")
    )


def threshold_accuracy(pred: DataFrame, by: Sequence[str] = (), eps: float = 0.1) -> DataFrame:
    inside = F.abs(F.col("predicted") - F.col("actual")) <= eps
    return pred.groupBy(*by).agg((100.0 * F.avg(inside.cast("double"))).alias("within_pct"))


def model_means(metrics: DataFrame, model: str = "model") -> DataFrame:
    """Average measures of each model over the entities."""
    return metrics.groupBy(model).agg(F.avg("r2").alias("r2"), F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"))


def best_models(metrics: DataFrame, by: Sequence[str] = ("entity",), model: str = "model") -> DataFrame:
    """Model with the highest R2 of each group (of all without ``by``); the alphabetically last on a tie."""
    best = F.max(F.struct("r2", F.col(model).alias("model"), *[c for c in ("entity",) if c not in by])).alias("b")
    return metrics.groupBy(*by).agg(best).select(*by, "b.*")


def model_leaderboard(metrics: DataFrame, entity: str = "entity", model: str = "model") -> DataFrame:
    """Models ranked inside each entity by R2."""
    w = Window.partitionBy(entity).orderBy(F.col("r2").desc(), F.col(model))
    return metrics.withColumn("place", F.row_number().over(w))


def best_epoch(history: DataFrame, by: Sequence[str] = ("entity",), patience: int = 15) -> DataFrame:
    """Best epoch by validation loss (first on a tie), epochs run since, and where patience would have stopped."""
    w = Window.partitionBy(*by).orderBy("epoch")
    before = F.min("val_loss").over(w.rowsBetween(START, -1))
    improved = history.withColumn("improved", before.isNull() | (F.col("val_loss") < before))
    last = F.max(F.when(F.col("improved"), F.col("epoch"))).over(w.rowsBetween(START, 0))
    waited = improved.withColumn("waited", F.col("epoch") - last)
    return waited.groupBy(*by).agg(
        F.min(F.struct("val_loss", "epoch"))["epoch"].alias("best_epoch"),
        F.min("val_loss").alias("best_val_loss"),
        F.max("epoch").alias("last_epoch"),
        F.min(F.when(F.col("waited") >= patience, F.col("epoch"))).alias("stop_epoch"),
    ).withColumn("epochs_since_best", F.col("last_epoch") - F.col("best_epoch"))


def metric_drift(pred: DataFrame, grain: str = "month", by: Sequence[str] = ("entity",), d: str = "d", target_r2: float = 0.75) -> DataFrame:
    """Measures per period, their change against the period before and whether the target is met."""
    period = F.trunc(d, "MM") if grain == "month" else F.trunc(d, "year") if grain == "year" else F.col(d)
    per = regression_metrics(pred.withColumn("period", period), [*by, "period"])
    w = Window.partitionBy(*by).orderBy("period")
    return per.withColumns(
        {"mae_change": F.col("mae") - F.lag("mae").over(w), "on_target": F.coalesce(F.col("r2") >= target_r2, F.lit(False))}
    )
