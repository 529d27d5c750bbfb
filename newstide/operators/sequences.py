"""Sliding input windows for forecasting and splits along time."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newstide.operators.sets import numbered
from newstide.operators.windows import series


def sequences(
    df: DataFrame, features: Sequence[str], target: str, length: int, by: Sequence[str] = ("entity",), d: str = "d"
) -> DataFrame:
    """For each row with ``length`` rows before it: ``x`` (those rows, oldest first) and ``y`` (the row's target)."""
    w = series(by, d)
    vector = F.array(*[F.col(f).cast("double") for f in features])
    return (
        df.select(
            *by,
            d,
            F.row_number().over(w).alias("_rn"),
            F.collect_list(vector).over(w.rowsBetween(-length, -1)).alias("x"),
            F.col(target).cast("double").alias("y"),
        )
        .where(F.col("_rn") > length)
        .drop("_rn")
    )


def temporal_split(
    df: DataFrame,
    fractions: Sequence[tuple[str, float]] = (("train", 0.8), ("test", 0.2)),
    by: Sequence[str] = ("entity",),
    d: str = "d",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Tag rows with the part of the time line they fall into; cut i is floor(n * sum of the first i fractions).

    With ``by`` each series is cut on its own, without it the whole table is, by date and ``tie``.
    """
    if by:
        w = Window.partitionBy(*by)
        ranked = df.withColumns({"_rn": F.row_number().over(w.orderBy(d, *tie)), "_n": F.count(F.lit(1)).over(w)})
    else:
        ranked = numbered(df, d, tie or ["entity"], "_rn").withColumn("_n", df.agg(F.count(F.lit(1))).scalar())
    ends = [round(e, 12) for e in accumulate(f for _, f in fractions)]
    cuts = [
        F.when(F.col("_rn") <= F.floor(F.col("_n") * end), F.lit(name))
        for (name, _), end in zip(fractions[:-1], ends[:-1], strict=True)
    ]
    return ranked.withColumn("split", F.coalesce(*cuts, F.lit(fractions[-1][0]))).drop("_rn", "_n")


def sequence_summary(seq: DataFrame, by: Sequence[str] = ("entity",), d: str = "d") -> DataFrame:
    """Rows and date span of each group and split."""
    return seq.groupBy(*by, "split").agg(
        F.count(F.lit(1)).alias("n"), F.min(d).alias("first_day"), F.max(d).alias("last_day")
    )
