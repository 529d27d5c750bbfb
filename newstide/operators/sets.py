"""Unions, ranks, last rows, spines and distributed row numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newstide.operators.skew import sliced_join

SLICES, SLICE_ROWS = 256, 100_000


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column missing on one side is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_tagged(parts: Mapping[tuple[str, str], DataFrame], key: str, metrics: Sequence[str]) -> DataFrame:
    """Stack different analyses as (analysis, source, key, metric, value), keeping their values."""
    tidy = []
    for (analysis, source), df in parts.items():
        present = [m for m in metrics if m in df.columns]
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in present])
        tidy.append(
            df.select(
                F.lit(analysis).alias("analysis"),
                F.lit(source).alias("source"),
                F.col(key).cast("string").alias("key"),
                F.explode(cells).alias("cell"),
            ).select("analysis", "source", "key", "cell.metric", "cell.value")
        )
    return union_all(tidy)


def duplicated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def last_rows(df: DataFrame, n: int, by: Sequence[str], d: str = "d", tie: Sequence[str] = ()) -> DataFrame:
    """The ``n`` latest rows of each group. Spark keeps ``n`` per group before the shuffle already."""
    w = Window.partitionBy(*by).orderBy(F.col(d).desc(), *[F.col(t).desc() for t in tie])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def latest(df: DataFrame, col: str, by: Sequence[str], d: str = "d") -> DataFrame:
    return df.groupBy(*by).agg(F.max_by(col, d).alias(col), F.max(d).alias(d))


def top_bottom(df: DataFrame, col: str, tie: str, k: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` highest and lowest rows, ranked from 1, with the tie column ascending.

    Sorted limits run per partition first, so nothing but ``k`` rows per task moves.
    """
    rows = df.where(F.col(col).isNotNull())

    def end(side: str, first: Column) -> DataFrame:
        w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(first, F.col(tie))
        best = rows if by else rows.orderBy(first, F.col(tie)).limit(k)
        return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("side", F.lit(side))

    return end("top", F.col(col).desc()).unionByName(end("bottom", F.col(col).asc()))


def keep_entities(df: DataFrame, dim: DataFrame, entity: str = "entity") -> DataFrame:
    return df.join(dim.select(entity).distinct(), entity, "left_semi")


def eligible_entities(df: DataFrame, n: int = 100, entity: str = "entity") -> DataFrame:
    """Entities with more than ``n`` rows."""
    return df.groupBy(entity).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > n)


def calendar(df: DataFrame, by: Sequence[str], d: str = "d") -> DataFrame:
    """Every day between each group's first and last."""
    return (
        df.groupBy(*by)
        .agg(F.min(d).alias("lo"), F.max(d).alias("hi"))
        .select(*by, F.explode(F.sequence("lo", "hi")).alias(d))
    )


def future_spine(df: DataFrame, n: int, by: Sequence[str], d: str = "d") -> DataFrame:
    """The ``n`` days after each group's last day, numbered from 1."""
    return (
        df.groupBy(*by)
        .agg(F.max(d).alias("last"))
        .select(*by, "last", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
        .select(*by, F.date_add("last", F.col("step")).alias(d), "step")
    )


def numbered(df: DataFrame, d: str, tie: Sequence[str], name: str = "rn") -> DataFrame:
    """Row number (from 1) over the whole table by date and tie columns, without a whole-table window.

    Rows are numbered inside their date; the rows of earlier dates come from a running sum over one count per date, a
    table no longer than the calendar.
    """
    per_day = df.groupBy(d).agg(F.count(F.lit(1)).alias("_n"))
    before = per_day.select(
        d, (F.sum("_n").over(Window.orderBy(d).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before")
    )
    place = F.row_number().over(Window.partitionBy(d).orderBy(*tie))
    return df.join(before, d).withColumn(name, F.col("_before") + place).drop("_before")


def numbered_in_groups(
    df: DataFrame, by: Sequence[str], order: str, name: str = "rn", slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Row number (from 1) inside each group by a unique numeric column, also where a group is too large for one task.

    Groups above ``slice_rows`` are cut into ranges of ``order`` at the steps of a quantile sketch. Rows are numbered
    inside their range and shifted by the rows of the ranges before it, of which a group has at most ``SLICES`` + 1.
    """
    steps = [i / SLICES for i in range(1, SLICES)]
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(order, steps).alias("_edges"))
    cuts = groups.select(
        *by, F.when(F.col("n") > slice_rows, F.col("_edges")).otherwise(F.slice("_edges", 1, 0)).alias("_edges")
    )
    ranged = (
        sliced_join(df, cuts, by, groups, order)
        .withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col(order))))
        .drop("_edges")
    )
    sizes = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    before = sizes.select(*by, "_range", "n", (upto - F.col("n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(order))
    return (
        ranged.withColumn("_in_range", place)
        .join(before.drop("n"), [*by, "_range"])
        .withColumn(name, F.col("_before") + F.col("_in_range"))
        .drop("_range", "_in_range", "_before")
    )
