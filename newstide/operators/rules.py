"""Rules on summaries: insights, warnings, successful events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insight_gap(comparison: DataFrame, entity: str = "entity") -> DataFrame:
    """Entities by mean score, each with the next lower one and the gap to it."""
    w = Window.orderBy(F.col("mean_score").desc(), entity)  # one row per entity
    return (
        comparison.select(
            F.col(entity).alias("winner"),
            F.lead(entity).over(w).alias("runner_up"),
            (F.col("mean_score") - F.lead("mean_score").over(w)).alias("gap"),
        ).where(F.col("runner_up").isNotNull())
    )


def insight_reliable(metrics: DataFrame, r2: float = 0.5) -> DataFrame:
    return metrics.where(F.col("r2") > r2)


def insight_volatile(comparison: DataFrame, std: float = 0.5) -> DataFrame:
    return comparison.where(F.col("std_score") > std)


def warning_level(price_change: Column, predicted_drop: Column, drop_price: float = 0.02, drop_score: float = 0.3) -> Column:
    """0 none, 1 price fell, 2 a score fall is predicted, 3 both together."""
    price = F.coalesce(price_change < -drop_price, F.lit(False))
    score = F.coalesce(predicted_drop > drop_score, F.lit(False))
    return F.when(price & score, 3).when(score, 2).when(price, 1).otherwise(0)


def early_warning(df: DataFrame, price_change: str, predicted_drop: str) -> DataFrame:
    return df.withColumn("level", warning_level(F.col(price_change), F.col(predicted_drop)))


def successful_launches(study: DataFrame, impact: float = 0.1) -> DataFrame:
    return study.where(F.col("score_change") > impact)
