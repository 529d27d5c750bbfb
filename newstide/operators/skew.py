"""Equi joins and stored intermediate tables that stay even when one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newstide.session import scratch_path

HOT_SHARE = 0.001  # a key above this share of the rows is split; there can be at most 1 / HOT_SHARE of them


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result that is read several times to the shared folder and read it back.

    Unlike a cached block it survives the loss of executors, and it ends the lineage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str = "n", share: float = HOT_SHARE) -> DataFrame:
    """Keys with more than ``share`` of all rows and the number of slices that brings each slice below it.

    The result has at most ``1 / share`` rows whatever the data, which is what makes broadcasting it safe.
    """
    unit = counts.agg(F.greatest(F.sum(n) * share, F.lit(1.0))).scalar()
    return counts.where(F.col(n) > unit).select(*keys, F.ceil(F.col(n) / unit).cast("int").alias("_slices"))


def sliced_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    counts: DataFrame,
    row_id: str,
    how: str = "inner",
    condition: Column | None = None,
    share: float = HOT_SHARE,
) -> DataFrame:
    """Join many ``rows`` with a ``lookup`` that is small per key, slicing the hot keys of ``rows``.

    ``counts`` has the keys and ``n``, their number of rows. Rows of a hot key go to a slice picked by ``row_id``; the
    lookup rows of that key are repeated for each slice.
    """
    hot = F.broadcast(hot_keys(counts, keys, share=share))
    slices = F.coalesce("_slices", F.lit(1))
    left = (
        rows.join(hot, list(keys), "left")
        .withColumn("_slice", F.pmod(F.xxhash64(row_id), slices).cast("int"))
        .drop("_slices")
    )
    right = (
        lookup.join(hot, list(keys), "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
        .drop("_slices")
    )
    on = [*keys, "_slice"]
    if condition is None:
        return left.join(right, on, how).drop("_slice")
    for k in on:
        right = right.withColumnRenamed(k, f"_r_{k}")
    test = condition
    for k in on:
        test = (F.col(k) == F.col(f"_r_{k}")) & test
    return left.join(right, test, how).drop("_slice", *[f"_r_{k}" for k in on])


def grid_cuts(victims: DataFrame, others: DataFrame, keys: Sequence[str], cell: int = 20_000) -> DataFrame:
    """How to cut each hot key of a many-to-many join so that no cell holds more than about ``cell`` rows of a side.

    A key with v rows left and o rows right becomes ceil(v/cell) x ceil(o/cell) cells: each left row is repeated along
    the right cuts and the other way round. Every key above the cell size is cut, however many there are.
    """
    v = victims.groupBy(*keys).agg(F.count(F.lit(1)).alias("_v"))
    o = others.groupBy(*keys).agg(F.count(F.lit(1)).alias("_o"))
    sizes = v.join(o, list(keys))
    return sizes.where((F.col("_v") > cell) | (F.col("_o") > cell)).select(
        *keys,
        F.ceil(F.col("_v") / cell).cast("int").alias("_cut_v"),
        F.ceil(F.col("_o") / cell).cast("int").alias("_cut_o"),
    )


def grid_place(df: DataFrame, cuts: DataFrame, keys: Sequence[str], row_id: str, victims: bool) -> DataFrame:
    """Rows of one side with their cell, the columns ``GRID_KEYS``."""
    mine, other = ("_cut_v", "_cut_o") if victims else ("_cut_o", "_cut_v")
    return (
        df.join(cuts, list(keys), "left")
        .withColumn(f"{mine}_cell", F.pmod(F.xxhash64(row_id), F.coalesce(mine, F.lit(1))).cast("int"))
        .withColumn(f"{other}_cell", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        .drop(mine, other)
    )


GRID_KEYS = ("_cut_v_cell", "_cut_o_cell")
