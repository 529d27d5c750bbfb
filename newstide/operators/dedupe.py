"""Exact de-duplication by key, first row in input order kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by ``order`` (a unique ordinal). NULL keys count as equal.

    The filter on the first row number becomes a group limit below the shuffle, so at most one row per key and task
    travels, however many copies a key has.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of keys that repeat and of rows beyond the first of each."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.count_if(F.col("n") > 1).alias("duplicated_keys"), F.sum(F.col("n") - 1).alias("surplus_rows")
    )
