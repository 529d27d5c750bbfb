"""The sample tables seen as scored items, prices, events and articles: as DataFrames and as SQL common tables.

Every binding reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newstide.operators.aggregates import daily_stats


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def obs(spark: SparkSession, sf: str) -> DataFrame:
    """Scored items: every order, with its priority as entity."""
    return as_items(table(spark, sf, "orders"))


def as_items(orders: DataFrame) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return orders.select(
        F.col("o_orderkey").alias("obs_id"),
        F.to_date("o_orderdate").alias("d"),
        F.col("o_orderpriority").alias("entity"),
        (1.0 + 4.0 * (cents % 99991) / 99990.0).alias("score"),
        F.when(F.col("o_orderstatus") == "F", "positive")
        .when(F.col("o_orderstatus") == "O", "negative")
        .otherwise("neutral")
        .alias("label"),
    )


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return daily_stats(obs(spark, sf))


def price(spark: SparkSession, sf: str) -> DataFrame:
    """Prices on weekdays; lines of a weekend count on the Monday after it.

    Lines are folded per order and day first, so that no order key is hot in the join.
    """
    shipped = F.to_date("l_shipdate")
    trading = F.date_add(shipped, F.greatest(7 - F.weekday(shipped), F.lit(0)) % 7 * (F.weekday(shipped) > 4).cast("int"))
    lines = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey", trading.alias("d"))
        .agg(F.sum(F.col("l_extendedprice") / F.col("l_quantity")).alias("s"), F.count(F.lit(1)).alias("n"))
    )
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("entity"))
    return (
        lines.join(orders, "l_orderkey")
        .groupBy("entity", "d")
        .agg((100.0 * (F.sum("s") / F.sum("n")) / 9973.0).alias("close"), F.sum("n").alias("vol"))
    )


def launches(spark: SparkSession, sf: str) -> DataFrame:
    """Calendar events: the largest order of each customer."""
    top = F.max(F.struct("o_totalprice", "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")).alias("t")
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("event_id"))
        .agg(top)
        .select(
            "event_id",
            F.col("t.o_orderpriority").alias("entity"),
            F.to_date("t.o_orderdate").alias("d"),
            F.col("t.o_orderstatus").alias("category"),
        )
    )


def articles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id",
        F.date_add(F.lit("2021-01-01").cast("date"), ((F.col("doc_id") * 7) % 1461).cast("int")).alias("d"),
        F.col("lang").alias("entity"),
        F.col("source").alias("publisher"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("body"),
        F.concat_ws(",", "lang", "source").alias("keywords"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Naive forecasts of the daily mean: yesterday's value, or a trailing mean of the rows before."""
    w = Window.partitionBy("entity").orderBy("d")
    named = F.array(
        F.struct(F.lit("last").alias("model"), F.lag("score_mean").over(w).alias("predicted")),
        F.struct(F.lit("ma7").alias("model"), F.avg("score_mean").over(w.rowsBetween(-7, -1)).alias("predicted")),
        F.struct(F.lit("ma30").alias("model"), F.avg("score_mean").over(w.rowsBetween(-30, -1)).alias("predicted")),
    )
    return (
        daily(spark, sf)
        .select("entity", "d", F.col("score_mean").alias("actual"), named.alias("models"))
        .select("entity", "d", "actual", F.explode("models").alias("m"))
        .select("entity", "d", "m.model", "actual", "m.predicted")
        .where(F.col("predicted").isNotNull())
    )


# Word lists for the invented prose of the sample documents.
POSITIVE = ("the", "la", "die", "el", "le")
NEGATIVE = ("and", "et", "und", "de", "of")
RELEVANT = ("nth", "eau", "ung", "ción")
RULES = (("alpha", ("tion", "eau")), ("beta", ("ing", "ung")))
VOTES = {"alpha": ("the", "tion", "eau", "ent"), "beta": ("and", "ing", "ung", "ou")}

CTE = {
    "obs": """obs as (select o_orderkey as obs_id, cast(o_orderdate as date) as d, o_orderpriority as entity,
  1e0 + 4e0 * (cast(round(o_totalprice * 100) as bigint) % 99991) / 99990e0 as score,
  case o_orderstatus when 'F' then 'positive' when 'O' then 'negative' else 'neutral' end as label from orders)""",
    "daily": """daily as (select entity, d, avg(score) as score_mean, coalesce(stddev_samp(score), 0) as score_std,
  count(*) as n_items, avg(case when label = 'positive' then 1e0 else 0e0 end) as positive_ratio
  from obs group by entity, d)""",
    "price": """price as (select o_orderpriority as entity,
  cast(l_shipdate as date) + cast(case isodow(l_shipdate) when 6 then 2 when 7 then 1 else 0 end as integer) as d,
  1e2 * avg(l_extendedprice / l_quantity) / 9973e0 as close, count(*) as vol
  from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)""",
    "launches": """launches as (select event_id, entity, d, category from (select o_custkey as event_id,
  o_orderpriority as entity, cast(o_orderdate as date) as d, o_orderstatus as category,
  row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey desc) as rn from orders) where rn = 1)""",
    "articles": """articles as (select doc_id, date '2021-01-01' + cast((doc_id * 7) % 1461 as integer) as d, lang as entity,
  source as publisher, split_part(text, chr(10), 1) as title, text as body, lang || ',' || source as keywords from documents)""",
    "smooth": """smooth as (select entity, d, case when count(close) over w >= 3 then avg(close) over w end as close from price
  window w as (partition by entity, year(d) order by d rows between 3 preceding and 3 following))""",
    "predictions": """predictions as (select entity, d, model, actual, predicted from (
  select entity, d, 'last' as model, score_mean as actual, lag(score_mean) over w as predicted from daily
    window w as (partition by entity order by d)
  union all select entity, d, 'ma7', score_mean, avg(score_mean) over w from daily
    window w as (partition by entity order by d rows between 7 preceding and 1 preceding)
  union all select entity, d, 'ma30', score_mean, avg(score_mean) over w from daily
    window w as (partition by entity order by d rows between 30 preceding and 1 preceding)) where predicted is not null)""",
}
NEEDS = {"daily": ["obs"], "smooth": ["price"], "predictions": ["daily"]}


def sql(body: str, *ctes: str) -> str:
    """``body`` behind a WITH clause of the named common tables and what they need.

    ``ctes`` may also hold further definitions written out in full.
    """
    names: list[str] = []

    def need(name: str) -> None:
        for n in NEEDS.get(name, []):
            need(n)
        if name not in names:
            names.append(name)

    for c in ctes:
        need(c)
    return f"with {', '.join(CTE.get(n, n) for n in names)} {body}" if names else body
