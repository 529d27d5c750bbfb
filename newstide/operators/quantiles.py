"""Exact percentiles with linear interpolation that never gather a whole group.

``percentile`` keeps every distinct value of a group in one buffer, which a group of unlimited size does not allow. Here rows
are folded to distinct values with their counts once. Each wanted rank then has a bracket of values, at first the whole group.
A round cuts every bracket of more than ``LEAF`` distinct values at the edges of a sketch, counts the parts exactly and keeps the
part with the rank, whatever the sketch was off by. What is left is small enough to be put in order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newstide.operators.skew import sliced_join, stored

LEAF = 50_000  # distinct values of a bracket that one task puts in order
CUTS = 64
ACCURACY = 1_000  # of the sketch; it only decides how evenly a bracket is cut


def melt(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Wide to long: ``by``, ``column``, ``value``; NULL values are dropped."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])
    return (
        df.select(*by, F.explode(cells).alias("cell"))
        .select(*by, "cell.column", "cell.value")
        .where(F.col("value").isNotNull())
    )


def fold_values(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Distinct values of each column and group with their number of rows ``n``, written once: the only read of ``df``."""
    return stored(melt(df, by, cols).groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n")), "values")


def _inside(folded: DataFrame, brackets: DataFrame, keys: Sequence[str], sizes: DataFrame) -> DataFrame:
    """The values of ``folded`` with the brackets they lie in; the values of a large group are cut in slices."""
    test = F.col("value").between(F.col("lo"), F.col("hi"))
    if keys == ["column"]:  # a few brackets for each column
        few = F.broadcast(brackets.withColumnRenamed("column", "_column"))
        return folded.join(few, (F.col("column") == F.col("_column")) & test).drop("_column")
    return sliced_join(folded, brackets, keys, sizes.select(*keys, F.col("distinct").alias("n")), "value", condition=test)


def _narrowed(folded: DataFrame, wanted: DataFrame, keys: Sequence[str], sizes: DataFrame) -> DataFrame:
    """``wanted`` with each bracket replaced by the part of it that holds the rank."""
    place = [*keys, "lo", "hi"]
    grid = [k / CUTS for k in range(1, CUTS)]
    rows = _inside(folded, wanted.select(*place).distinct(), keys, sizes)
    edges = stored(rows.groupBy(*place).agg(F.percentile_approx("value", grid, ACCURACY).alias("edges")), "edges")
    part = F.size(F.filter("edges", lambda e: e < F.col("value")))
    parts = (
        _inside(folded, edges, keys, sizes)
        .groupBy(*place, part.alias("part"))
        .agg(F.sum("n").alias("mass"), F.count(F.lit(1)).alias("size"), F.min("value").alias("first"), F.max("value").alias("last"))
    )
    upto = F.sum("mass").over(Window.partitionBy(*place).orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    counted = parts.withColumn("start", upto - F.col("mass"))
    here = F.col("rank") - F.col("before") - F.col("start")
    found = wanted.drop("distinct").join(counted, place).where((here >= 0) & (here < F.col("mass")))
    return found.select(
        *keys, "name", "side", "rank", F.col("first").alias("lo"), F.col("last").alias("hi"),
        (F.col("before") + F.col("start")).alias("before"), F.col("size").alias("distinct"),
    )


def ranks(folded: DataFrame, by: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Percentiles of ``fold_values``: one row per group and column with a column for each named probability."""
    keys = [*by, "column"]
    sizes = stored(
        folded.groupBy(*keys).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.min("value").alias("lo"), F.max("value").alias("hi")),
        "sizes",
    )
    spot = lambda p: F.lit(float(p)) * (F.col("total") - 1)
    ends = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), end(spot(p)).cast("long").alias("rank"))
            for name, p in probs.items()
            for side, end in (("low", F.floor), ("high", F.ceil))
        ]
    )
    wanted = sizes.select(*keys, "lo", "hi", "distinct", F.lit(0).cast("long").alias("before"), F.inline(ends))
    wide = (F.col("distinct") > LEAF) & (F.col("lo") < F.col("hi"))
    while not wanted.where(wide).isEmpty():
        wanted = stored(wanted.where(~wide).unionByName(_narrowed(folded, wanted.where(wide), keys, sizes)), "ranks")

    place = [*keys, "lo", "hi"]
    rows = _inside(folded, wanted.select(*place).distinct(), keys, sizes)
    upto = F.sum("n").over(Window.partitionBy(*place).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ordered = rows.select(*place, "value", "n", (upto - F.col("n")).alias("start"))
    here = F.col("rank") - F.col("before") - F.col("start")
    at = wanted.join(ordered, place).where((here >= 0) & (here < F.col("n")))
    values = at.groupBy(*keys).agg(
        *[F.max(F.when((F.col("name") == n) & (F.col("side") == s), F.col("value"))).alias(f"_{n}_{s}") for n in probs for s in ("low", "high")]
    )
    between = {n: F.col(f"_{n}_low") + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * (spot(p) - F.floor(spot(p))) for n, p in probs.items()}
    return values.join(sizes, keys).select(*keys, *[c.alias(n) for n, c in between.items()])


def exact_percentiles(df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """One row per group and column with a column for each named probability."""
    return ranks(fold_values(df, by, cols), by, probs)
