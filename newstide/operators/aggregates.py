"""Grouped summaries of scored items and daily series.

Items are rows of ``entity``, ``d`` (date), ``score`` and ``label``; a daily series has one row per entity and day.
All of it is partial (map-side) aggregation, so a hot entity or label shrinks before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newstide.operators.blocks import correlations
from newstide.operators.quantiles import fold_values, ranks
from newstide.operators.skew import sliced_join, stored

ALL = "ALL"


def share(condition: Column) -> Column:
    """Share of rows meeting a condition; NULL counts as not meeting it."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def daily_mean(items: DataFrame, entity: str = "entity", d: str = "d", score: str = "score") -> DataFrame:
    return items.where(F.col(d).isNotNull()).groupBy(entity, d).agg(F.avg(score).alias("score"))


def daily_stats(
    items: DataFrame, entity: str = "entity", d: str = "d", score: str = "score", label: str = "label"
) -> DataFrame:
    """Mean, sample deviation (0 for a single item), count and share of positive labels per entity and day."""
    return (
        items.where(F.col(d).isNotNull())
        .groupBy(entity, d)
        .agg(
            F.avg(score).alias("score_mean"),
            F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("score_std"),
            F.count(F.lit(1)).alias("n_items"),
            share(F.col(label) == "positive").alias("positive_ratio"),
        )
    )


def fold_items(items: DataFrame, entity: str = "entity", d: str = "d", score: str = "score", label: str = "label") -> DataFrame:
    """Items folded to one row per entity, day and label, written once: the one read of the items that reports need.

    n rows, k rows with a score, their mean, m2 (squared deviations from it), low and high. Rows of this table can be merged
    further by ``merged`` in any grouping.
    """
    columns = [F.col(entity).alias("entity"), F.col(d).alias("d"), F.col(label).alias("label")]
    folded = items.groupBy(*columns).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(score).alias("k"),
        F.avg(score).alias("mean"),
        (F.var_pop(score) * F.count(score)).alias("m2"),
        F.min(score).alias("low"),
        F.max(score).alias("high"),
    )
    return stored(folded, "items")


def merged(folded: DataFrame, *by: str | Column) -> DataFrame:
    """Count, mean and sample deviation of the score, its ends and span of days, shares of labels, per group of ``by``.

    Sums are taken around the mean of the folded rows, so a large level does not cancel.
    """
    center = folded.agg(F.avg("mean")).scalar()
    off = F.col("mean") - center
    sums = folded.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("k").alias("_k"),
        F.sum(F.col("k") * off).alias("_s"),
        F.sum(F.col("m2") + F.col("k") * off * off).alias("_q"),
        F.min("low").alias("min_score"),
        F.max("high").alias("max_score"),
        F.min("d").alias("first_day"),
        F.max("d").alias("last_day"),
        F.sum(F.when(F.col("label") == "positive", F.col("n")).otherwise(0)).alias("_p"),
        F.sum(F.when(F.col("label") == "negative", F.col("n")).otherwise(0)).alias("_n"),
    )
    rest = F.greatest(F.col("_q") - F.col("_s") * F.col("_s") / F.col("_k"), F.lit(0.0))
    return sums.withColumns(
        {
            "mean_score": F.when(F.col("_k") > 0, center + F.col("_s") / F.col("_k")),
            "std_score": F.when(F.col("_k") > 1, F.sqrt(rest / (F.col("_k") - 1))),
            "positive_ratio": F.col("_p") / F.col("n"),
            "negative_ratio": F.col("_n") / F.col("n"),
        }
    ).drop("_k", "_s", "_q", "_p", "_n")


def _all_rows(folded: DataFrame) -> Column:
    return folded.agg(F.sum("n")).scalar()


def label_shares(folded: DataFrame) -> DataFrame:
    return folded.groupBy("label").agg(F.sum("n").alias("n")).withColumn("pct", 100.0 * F.col("n") / _all_rows(folded))


def label_distribution(items: DataFrame, label: str = "label") -> DataFrame:
    """Count and percentage per label."""
    counts = stored(items.groupBy(label).agg(F.count(F.lit(1)).alias("n")), "labels")
    return counts.withColumn("pct", 100.0 * F.col("n") / _all_rows(counts))


def compared(folded: DataFrame) -> DataFrame:
    table = merged(folded, "entity").select("entity", "n", "mean_score", "std_score", "positive_ratio", "negative_ratio")
    return table.withColumn("share_pct", 100.0 * F.col("n") / _all_rows(folded))


def entity_comparison(
    items: DataFrame, entity: str = "entity", score: str = "score", label: str = "label"
) -> DataFrame:
    counts = items.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mean_score"),
        F.stddev_samp(score).alias("std_score"),
        share(F.col(label) == "positive").alias("positive_ratio"),
        share(F.col(label) == "negative").alias("negative_ratio"),
    )
    counts = stored(counts, "entities")
    return counts.withColumn("share_pct", 100.0 * F.col("n") / _all_rows(counts))


def yearly_mean(items: DataFrame, d: str = "d", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    return items.groupBy(*by, F.year(d).alias("year")).agg(F.avg(score).alias("mean_score"))


def yearly_trend(items: DataFrame, d: str = "d", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """First and last year's mean, the direction between them and its size."""
    return trend(yearly_mean(items, d, score, by), by)


def trend(yearly: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    ends = yearly.groupBy(*by).agg(
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.min_by("mean_score", "year").alias("first_mean"),
        F.max_by("mean_score", "year").alias("last_mean"),
    )
    return ends.withColumns(
        {
            "direction": F.when(F.col("last_mean") > F.col("first_mean"), "up").otherwise("down"),
            "magnitude": F.abs(F.col("last_mean") - F.col("first_mean")),
        }
    )


def monthly_mean(daily: DataFrame, entity: str = "entity", d: str = "d", value: str = "score") -> DataFrame:
    return daily.groupBy(entity, F.trunc(d, "MM").alias("month")).agg(F.avg(value).alias("mean_score"))


def monthly_volatility(items: DataFrame, d: str = "d", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Mean over months of the standard deviation inside each month."""
    monthly = items.groupBy(*by, F.trunc(d, "MM").alias("month")).agg(F.stddev_samp(score).alias("s"))
    return monthly.groupBy(*by).agg(F.avg("s").alias("volatility"))


def overview(items: DataFrame, entity: str = "entity", d: str = "d", score: str = "score", label: str = "label") -> DataFrame:
    """Count, score moments, date span and items per day with data: one row, from one read of the items."""
    return overview_of(fold_items(items, entity, d, score, label))


def overview_of(folded: DataFrame) -> DataFrame:
    days = merged(folded).withColumn("items_per_day", folded.groupBy("d").agg(F.sum("n").alias("n")).agg(F.avg("n")).scalar())
    return days.drop("positive_ratio", "negative_ratio")


def histogram(items: DataFrame, value: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins on [min, max] of each group, the top edge inside the last bin, plus the group's mean.

    A group with one distinct value gets the unit interval around it. Empty bins are listed with count 0. Rows without a group
    are left out.
    """
    keys = list(by)
    rows = items.select(*keys, F.col(value).cast("double").alias("v")).dropna()
    if not keys:
        keys = ["_all"]
        rows = rows.withColumn("_all", F.lit(0))
    edges = rows.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean_value"))
    flat = F.col("lo") == F.col("hi")
    edges = stored(
        edges.select(
            *keys,
            "n",
            F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
            "mean_value",
        ),
        "edges",
    )
    spot = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    placed = sliced_join(rows, edges.select(*keys, "lo", "hi"), keys, edges.select(*keys, "n"), "v") if by else rows.crossJoin(F.broadcast(edges.select("lo", "hi")))
    counts = (
        placed.groupBy(*keys, F.least(spot, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("hi") - F.col("lo")) / bins
    return (
        edges.drop("n").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        .join(counts, [*keys, "bin"], "left")
        .select(
            *by,
            "bin",
            (F.col("lo") + F.col("bin") * width).alias("bin_low"),
            (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_high"),
            F.coalesce("n", F.lit(0)).cast("long").alias("n"),
            "mean_value",
        )
    )


def describe_by(df: DataFrame, entity: str, cols: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, quartiles and max of each column, per entity and over ALL of them.

    Rows are read once and folded to distinct values; both levels come from that table, so no row is doubled. Rows without an
    entity count in ALL only.
    """
    quarters = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    folded = fold_values(df.withColumn(entity, F.col(entity).cast("string")), [entity], cols)
    center = {r["column"]: r["m"] for r in folded.groupBy("column").agg(F.avg("value").alias("m")).collect()}  # one number a column
    off = F.col("value") - F.coalesce(*[F.when(F.col("column") == c, F.lit(m)) for c, m in center.items()], F.lit(0.0))
    sums = {"count": F.sum("n"), "_s": F.sum(F.col("n") * off), "_q": F.sum(F.col("n") * off * off), "mean": F.sum(F.col("n") * F.col("value")), "min": F.min("value"), "max": F.max("value")}

    def level(by: Sequence[str]) -> DataFrame:
        keys = [*by, "column"]
        rows = folded.dropna(subset=list(by)) if by else folded
        table = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])
        rest = F.greatest(F.col("_q") - F.col("_s") * F.col("_s") / F.col("count"), F.lit(0.0))
        moments = table.withColumns({"mean": F.col("mean") / F.col("count"), "std": F.when(F.col("count") > 1, F.sqrt(rest / (F.col("count") - 1)))})
        out = moments.join(ranks(rows, by, quarters), keys, "left")
        return out if by else out.withColumn(entity, F.lit(ALL))

    return level([entity]).unionByName(level([])).select(entity, "column", "count", "mean", "std", "min", "max", *quarters)


def corr_by(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(F.corr(x, y).alias("correlation"), F.count(F.col(x) + F.col(y)).alias("n"))


def corr_matrix(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Upper triangle of the Pearson matrix over pairwise complete rows: ``left``, ``right``, ``correlation``."""
    return correlations(df, cols, by).drop("n")


def launch_summary(events: DataFrame, entity: str = "entity", d: str = "d", category: str = "category") -> DataFrame:
    """Event counts per entity, entity and year, and entity and category, as (entity, dimension, value, n)."""
    return (
        events.select(
            entity,
            F.explode(
                F.array(
                    F.struct(F.lit("total").alias("dimension"), F.lit(ALL).alias("value")),
                    F.struct(F.lit("year").alias("dimension"), F.year(d).cast("string").alias("value")),
                    F.struct(F.lit("category").alias("dimension"), F.col(category).cast("string").alias("value")),
                )
            ).alias("cell"),
        )
        .groupBy(entity, "cell.dimension", "cell.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def launch_calendar(events: DataFrame, entity: str = "entity", d: str = "d") -> DataFrame:
    """Span, events per calendar year of the span and the busiest month (the earliest on a tie) of each entity."""
    months = events.groupBy(entity, F.month(d).alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.min(d).alias("lo"), F.max(d).alias("hi")
    )
    return (
        months.groupBy(entity)
        .agg(
            F.sum("n").alias("n"),
            F.min("lo").alias("first_day"),
            F.max("hi").alias("last_day"),
            F.max_by("month", F.struct(F.col("n"), -F.col("month"))).alias("peak_month"),
        )
        .withColumn("per_year", F.col("n") / (F.year("last_day") - F.year("first_day") + 1))
    )


def impact_by_category(study: DataFrame, category: str = "category") -> DataFrame:
    return study.groupBy(category).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("score_change").alias("score_change_mean"),
        F.stddev_samp("score_change").alias("score_change_std"),
        F.avg("price_change_pct").alias("price_change_mean"),
        F.stddev_samp("price_change_pct").alias("price_change_std"),
        share(F.col("significant")).alias("significant_rate"),
    )


def impact_summary(study: DataFrame, category: str = "category") -> DataFrame:
    """Number of events and significant events, mean changes, and a category → count map, in one row."""
    per_category = study.groupBy(F.coalesce(category, F.lit("Unknown")).alias("category")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("significant").alias("n_significant"),
        F.sum("score_change").alias("score_sum"),
        F.count("score_change").alias("score_n"),
        F.sum("price_change_pct").alias("price_sum"),
        F.count("price_change_pct").alias("price_n"),
    )
    return per_category.agg(
        F.sum("n").alias("n_events"),
        F.sum("n_significant").alias("n_significant"),
        F.try_divide(F.sum("score_sum"), F.sum("score_n")).alias("score_change_mean"),
        F.try_divide(F.sum("price_sum"), F.sum("price_n")).alias("price_change_mean"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(F.col("category").alias("k"), "n")))
        ).alias("category_breakdown"),
    )


def feature_groups(features: DataFrame, rules: Mapping[str, Sequence[str]], name: str = "feature") -> DataFrame:
    """Members and size of each feature group; a feature joins every group one of whose fragments it contains."""
    memberships = F.filter(
        F.array(
            *[
                F.when(reduce(or_, [F.contains(F.col(name), F.lit(f)) for f in fragments], F.lit(False)), F.lit(group))
                for group, fragments in rules.items()
            ]
        ),
        lambda g: g.isNotNull(),
    )
    return (
        features.select(F.col(name).alias("feature"), F.explode(memberships).alias("feature_group"))
        .groupBy("feature_group")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.concat_ws(",", F.array_sort(F.collect_list("feature"))).alias("members"),
        )
    )
