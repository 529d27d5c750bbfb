"""Queries that write, read back and profile files, and streaming runs over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from newstide.catalog.bindings import articles, launches, obs, price, sql, table
from newstide.catalog.registry import query, r6, rounded
from newstide.functions.text import clean_strict, entity_first_match
from newstide.functions.words import NEWS_FRAGMENTS, NEWS_HEADERS
from newstide.operators.aggregates import entity_comparison
from newstide.operators.asof import event_reach
from newstide.session import scratch_path
from newstide.sources import sinks, tables
from newstide.streaming import twins


@query(
    "csv_round_trip",
    sql(
        """select entity, cast(year(d) as int) as year, count(*) as n, round(sum(score), 6) as score_sum, min(d) as first_day, max(d) as last_day
        from obs group by 1, 2""",
        "obs",
    ),
)
def _(spark, sf):
    path = scratch_path(spark, "items-csv")
    items = obs(spark, sf).withColumn("year", F.year("d"))
    sinks.write_by_key(items, path, ["entity", "year"], ["d", "obs_id"], file_bytes=1 << 18)
    schema = T.StructType(
        [
            T.StructField("obs_id", T.LongType()),
            T.StructField("d", T.DateType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("label", T.StringType()),
            T.StructField("entity", T.StringType()),
            T.StructField("year", T.IntegerType()),
        ]
    )
    back = tables.read_csv(spark, path, schema)
    return rounded(
        back.groupBy("entity", "year").agg(
            F.count(F.lit(1)).alias("n"), F.sum("score").alias("score_sum"), F.min("d").alias("first_day"), F.max("d").alias("last_day")
        )
    )


def _price_text(spark, sf):
    """Prices as text: one entity group in US style with suffixed volumes, the others ISO with plain numbers."""
    us = F.col("entity") < "3"
    text = price(spark, sf).select(
        "entity",
        "d",
        F.when(us, F.date_format("d", "MM/dd/yyyy")).otherwise(F.date_format("d", "yyyy-MM-dd")).alias("Date"),
        *[F.col("close").cast("string").alias(c) for c in ("Close", "Open", "High", "Low")],
        F.when(us, F.concat((F.col("vol") / 1000).cast("decimal(18,3)").cast("string"), F.lit("K")))
        .otherwise(F.col("vol").cast("string"))
        .alias("Vol."),
    )
    return text


@query("parsed_prices", sql("select entity, d, round(close, 6) as close, vol as volume from price", "price"))
def _(spark, sf):
    parsed = tables.parse_prices(_price_text(spark, sf).drop("d"))
    return rounded(parsed.select("entity", "d", "close", "volume"))


@query(
    "price_file_profile",
    sql(
        """select 'price_' || year(d) as file, count(*) as n_rows, min(d) as first_day, max(d) as last_day, cast(year(d) as int) as file_year,
          false as year_mismatch from price group by year(d)""",
        "price",
    ),
)
def _(spark, sf):
    path = scratch_path(spark, "price-files")
    text = _price_text(spark, sf).withColumn("file", F.concat(F.lit("price_"), F.year("d"))).drop("d")
    sinks.write_by_key(text, path, ["file"], ["Date"])
    raw = tables.strip_headers(tables.read_csv(spark, path))
    return tables.file_profile(tables.parse_prices(raw))


@query(
    "file_name_year",
    sql(
        """select named as file, count(*) as n_rows, min(d) as first_day, max(d) as last_day, cast(split_part(named, '_', 2) as int) as file_year,
          cast(split_part(named, '_', 2) as int) <> year(min(d)) as year_mismatch
        from (select d, 'price_' || year(d) + cast(year(d) % 3 = 0 as int) || '_' || year(d) as named from price) group by named""",
        "price",
    ),
)
def _(spark, sf):
    """The year is taken from the name; some files hold another year than they say."""
    path = scratch_path(spark, "named-files")
    year = F.year("d")
    named = F.concat_ws("_", F.lit("price"), year + (year % 3 == 0).cast("int"), year)
    sinks.write_by_key(_price_text(spark, sf).withColumn("name", named).drop("d"), path, ["name"], ["Date"])
    raw = tables.with_file(tables.read_csv(spark, f"{path}/*", tables.PRICE_TEXT_WITH_ENTITY), "folder", level=2)
    prices = tables.parse_prices(tables.require_columns(tables.strip_headers(raw), ["Date", "Close"]))
    named_file = prices.withColumn("file", F.split_part("folder", F.lit("="), F.lit(2)))
    profile = tables.file_profile(named_file)
    return profile.withColumn("file_year", tables.file_part(F.col("file")).cast("int"))


@query(
    "tolerant_load",
    sql(
        """select 'price_' || year(d) as file, case when year(d) % 2 = 0 then 'no header' else 'read' end as status,
          cast(case when year(d) % 2 = 0 then 0 else count(*) end as bigint) as n_rows,
          cast(case when year(d) % 2 = 0 then 0 else count_if(vol % 5 = 0) end as bigint) as n_broken,
          cast(case when year(d) % 2 = 0 then 0 else count_if(vol % 5 = 0) end as bigint) as n_missing,
          round(case when year(d) % 2 = 0 then 0 else coalesce(sum(close) filter (where vol % 5 <> 0), 0) end, 6) as close_sum from price group by year(d)""",
        "price",
    ),
)
def _(spark, sf):
    """Files of which some have no Close and some hold numbers that are none: what is read, and what is lost where."""
    path = scratch_path(spark, "tolerant-files")
    text = price(spark, sf).select(
        F.concat(F.lit("price_"), F.year("d")).alias("file"),
        F.col("d").cast("string").alias("Date"),
        F.when(F.col("vol") % 5 == 0, F.lit("n/a")).otherwise(F.col("close").cast("string")).alias("Close"),
        (F.year("d") % 2 == 0).alias("other"),
    )
    for other, name in ((False, "Close"), (True, "Last")):
        some = text.where(F.col("other") == other).drop("other").withColumnRenamed("Close", name)
        sinks.write_by_key(some, f"{path}/{name}", ["file"], ["Date"])
    schema = T.StructType([T.StructField("Date", T.DateType()), T.StructField("Close", T.DoubleType())])
    rows, report = tables.tolerant_load(spark, f"{path}/*/*", schema, ["Close", "Date"])
    sums = rows.groupBy("path").agg(F.sum("Close").alias("close_sum"))
    file = F.split_part(F.element_at(F.split("path", "/"), -2), F.lit("="), F.lit(2))
    both = report.join(sums, "path", "left").groupBy(file.alias("file"), "status")
    return rounded(both.agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_broken", "n_missing")], F.coalesce(F.sum("close_sum"), F.lit(0.0)).alias("close_sum")))


@query("legacy_charset", sql("select doc_id, regexp_replace(title, '[^\x00-\xFF]', '?', 'g') as title from articles", "articles"))
def _(spark, sf):
    """Titles through files in ISO-8859-1; what that charset lacks comes back as a question mark."""
    path = scratch_path(spark, "latin-csv")
    articles(spark, sf).select("doc_id", "title").write.options(header=True, encoding="ISO-8859-1", escape='"', emptyValue="").csv(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("title", T.StringType())])
    back = tables.read_csv(spark, path, schema, encoding="ISO-8859-1")
    return back.select("doc_id", F.coalesce("title", F.lit("")).alias("title"))


@query("resolved_aliases", sql("select doc_id as news_id, d as date, publisher, title, keywords from articles", "articles"))
def _(spark, sf):
    """Headers by their list of accepted names, the first one that is there."""
    raw = articles(spark, sf).select(
        F.col("doc_id").alias("뉴스식별자"),
        F.lit(None).cast("string").alias("ID"),  # an accepted name too, but a later one
        F.col("d").alias("일자"),
        F.col("publisher").alias("신문사"),
        F.col("title").alias("제목"),
        F.col("keywords").alias("keyword"),
        F.lit("x").alias("other"),
    )
    return tables.resolve_columns(raw, NEWS_HEADERS)


@query(
    "resolved_headers",
    sql("select doc_id, title, keywords, publisher, cast(strftime(d, '%Y%m%d') as varchar) as date from articles", "articles"),
)
def _(spark, sf):
    raw = articles(spark, sf).select(
        F.col("doc_id").alias(" Doc_Id "),
        F.date_format("d", "yyyyMMdd").alias("발행일자"),
        F.col("title").alias("Title"),
        F.col("keywords").alias("Keyword list"),
        F.col("publisher").alias("media"),
    )
    fragments = {"doc_id": ("doc_id",), **{k: v for k, v in NEWS_FRAGMENTS.items() if k != "body"}}
    return tables.resolve_fuzzy(tables.strip_headers(raw), fragments)


@query(
    "json_summary_round_trip",
    sql("select entity, count(*) as n, round(avg(score), 6) as mean_score from obs group by entity", "obs"),
)
def _(spark, sf):
    path = scratch_path(spark, "summary-json")
    sinks.write_json(rounded(entity_comparison(obs(spark, sf))), path)
    return spark.read.schema("entity string, n bigint, mean_score double").json(path)


@query(
    "column_profile",
    " union all ".join(
        f"select '{c}' as \"column\", count(*) as n_rows, count({c}) as n_present from orders"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    ),
)
def _(spark, sf):
    return tables.null_profile(table(spark, sf, "orders")).select("column", "n_rows", "n_present")


# --- streaming -------------------------------------------------------------------------------------------------------

STREAM_ITEMS = """sitems as (select event_id, ts, event_type as entity, user_id, 1e0 + 4e0 * (cast(round(value * 100) as bigint) % 9973) / 9972e0 as score,
  case when value >= 50 then 'positive' when value >= 10 then 'neutral' else 'negative' end as label, props from events)"""
AGG = """avg(score) as score_mean, coalesce(stddev_samp(score), 0) as score_std, count(*) as n_items,
  avg(case when label = 'positive' then 1e0 else 0e0 end) as positive_ratio"""


def _feed(spark, sf):
    """Path and schema. A pattern matches the table whether it is one file or a folder of files; a stream takes no plain file path."""
    return f"{sf}/events.parque[t]", table(spark, sf, "events").schema


def _events(spark, sf):
    return twins.read_stream(spark, *_feed(spark, sf))


def _closed(spark, sf, build, name):
    return twins.run_closed(spark, *_feed(spark, sf), lambda feed: build(_items(feed)), name)


def _items(df):
    cents = F.round(F.col("value") * 100).cast("long")
    return df.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("entity"),
        "user_id",
        (1.0 + 4.0 * (cents % 9973) / 9972.0).alias("score"),
        F.when(F.col("value") >= 50, "positive").when(F.col("value") >= 10, "neutral").otherwise("negative").alias("label"),
        "props",
    )


@query(
    "stream_clean_and_tag",
    sql(
        r"""select event_id, trim(regexp_replace(regexp_replace(props, '[^\p{L}\p{N}_\s.,!?:%-]', ' ', 'g'), '\s+', ' ', 'g')) as cleaned,
          case when contains(lower(entity), 'error') then 'fault' when contains(lower(entity), 'i') then 'contact' end as tag, round(score, 6) as score
        from sitems""",
        STREAM_ITEMS,
    ),
)
def _(spark, sf):
    rules = (("fault", ("error",)), ("contact", ("i",)))
    out = _items(_events(spark, sf)).select(
        "event_id", clean_strict("props").alias("cleaned"), entity_first_match("entity", rules).alias("tag"), r6("score").alias("score")
    )
    return twins.run_available(out, "stream-clean")


DAY_WINDOWS = f"""days as (select entity, w_start, {AGG} from (select *, cast(date_trunc('day', ts) as timestamp) as w_start from sitems) group by 1, 2)"""
OUT = """round(score_mean, 6) as score_mean, round(score_std, 6) as score_std, n_items, round(positive_ratio, 6) as positive_ratio"""


def _windows(items, **options):
    stats = twins.windowed_stats(items, ["entity"], **options)
    return stats.select("entity", F.col("w.start").alias("w_start"), "score_mean", "score_std", "n_items", "positive_ratio")


@query("stream_daily_stats", sql(f"select entity, w_start, {OUT} from days", STREAM_ITEMS, DAY_WINDOWS))
def _(spark, sf):
    return rounded(_closed(spark, sf, _windows, "stream-daily"))


@query(
    "stream_sliding_mean",
    sql(
        f"""select entity, w_start, {OUT} from (select entity, w_start, {AGG} from (select *, cast(date_trunc('day', ts) - k * interval 1 day as timestamp) as w_start
          from sitems, (select unnest(range(7)) as k)) group by 1, 2)""",
        STREAM_ITEMS,
    ),
)
def _(spark, sf):
    return rounded(_closed(spark, sf, lambda items: _windows(items, length="7 days", slide="1 day"), "stream-sliding"))


@query(
    "stream_unique",
    sql("select distinct entity, user_id, cast(ts as date) as d from sitems", STREAM_ITEMS),
)
def _(spark, sf):
    items = _items(_events(spark, sf)).select("entity", "user_id", F.to_date("ts").alias("d"), "ts")
    out = twins.unique_within(items, ["entity", "user_id", "d"])
    return twins.run_available(out, "stream-unique").select("entity", "user_id", "d")


@query("stream_threshold_alerts", sql("select entity, w_start, round(score_mean, 6) as score_mean from days where score_mean < 2.9", STREAM_ITEMS, DAY_WINDOWS))
def _(spark, sf):
    low = lambda items: twins.threshold_alerts(_windows(items).select("entity", "w_start", "score_mean"), 2.9)
    return rounded(_closed(spark, sf, low, "stream-alerts"))


@query(
    "stream_change_alerts",
    sql(
        """select a.entity, a.w_start, round(a.score_mean, 6) as score_mean, round(a.score_mean - b.score_mean, 6) as change
        from days a join days b on a.entity = b.entity and b.w_start = a.w_start - interval 1 day where a.score_mean - b.score_mean < -0.2""",
        STREAM_ITEMS,
        DAY_WINDOWS,
    ),
)
def _(spark, sf):
    return rounded(_closed(spark, sf, lambda items: twins.change_alerts(items, ["entity"], 0.2), "stream-changes"))


@query(
    "stream_with_static",
    sql(
        """select event_id, coalesce(n, 0) as n_launches, round(impact, 6) as impact from (select event_id, cast(ts as date) as day from sitems)
        left join (select d, count(*) as n, sum(exp(-abs(d - e) / 30e0)) as impact from (select cast(e + cast(k as integer) as date) as d, e
          from (select date '2024-01-01' + cast((event_id % 365) as integer) as e, unnest(range(-60, 61)) as k from launches)) group by d) on d = day""",
        STREAM_ITEMS,
        "launches",
    ),
)
def _(spark, sf):
    moved = launches(spark, sf).select(
        F.lit("all").alias("entity"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("event_id") % 365).cast("int")).alias("d"),
    )
    reach = event_reach(moved).select("d", F.col("events_nearby").alias("n_launches"), F.col("event_impact").alias("impact"))
    items = _items(_events(spark, sf)).select("event_id", F.to_date("ts").alias("d"))
    joined = twins.with_static(items, reach, ["d"]).select("event_id", F.coalesce("n_launches", F.lit(0)).cast("long").alias("n_launches"), "impact")
    return rounded(twins.run_available(joined, "stream-static"))
