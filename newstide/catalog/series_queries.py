"""Queries over scored items and daily series: aggregates, windows, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from newstide.catalog.bindings import daily, launches, obs, price, sql, table
from newstide.catalog.registry import query, r6, rounded
from newstide.operators import aggregates as A
from newstide.operators import rules as R
from newstide.operators import sets as S
from newstide.operators import windows as W
from newstide.operators.quantiles import exact_percentiles
from newstide.plans.series import FEATURE_GROUPS, chart_series, daily_series, smoothed_price

WE = "partition by entity order by d"
WY = "partition by entity, year(d) order by d"


def rows(n: int, m: int = 0) -> str:
    end = "current row" if m == 0 else f"{m} following"
    return f"rows between {n} preceding and {end}"


@query(
    "daily_series",
    sql(
        f"""select entity, d, round(score_mean, 6) as score_mean, round(score_std, 6) as score_std, n_items,
          round(positive_ratio, 6) as positive_ratio, round(avg(score_mean) over ({WE} {rows(6)}), 6) as score_ma7,
          round(avg(score_mean) over ({WE} {rows(29)}), 6) as score_ma30, round(avg(n_items) over ({WE} {rows(6)}), 6) as n_items_ma7
        from daily""",
        "daily",
    ),
)
def _(spark, sf):
    return rounded(daily_series(obs(spark, sf)))


@query("daily_mean", sql("select entity, d, round(score_mean, 6) as score from daily", "daily"))
def _(spark, sf):
    return rounded(A.daily_mean(obs(spark, sf)))


@query(
    "daily_stats",
    sql(
        """select entity, d, round(score_mean, 6) as score_mean, round(score_std, 6) as score_std, n_items,
        round(positive_ratio, 6) as positive_ratio from daily""",
        "daily",
    ),
)
def _(spark, sf):
    return rounded(daily(spark, sf))


@query(
    "label_distribution",
    sql("select label, count(*) as n, round(100e0 * count(*) / (select count(*) from obs), 6) as pct from obs group by label", "obs"),
)
def _(spark, sf):
    return rounded(A.label_distribution(obs(spark, sf)))


CMP = """cmp as (select entity, count(*) as n, avg(score) as mean_score, stddev_samp(score) as std_score,
  avg(case when label = 'positive' then 1e0 else 0e0 end) as positive_ratio,
  avg(case when label = 'negative' then 1e0 else 0e0 end) as negative_ratio,
  100e0 * count(*) / (select count(*) from obs) as share_pct from obs group by entity)"""
CMP_COLS = """entity, n, round(mean_score, 6) as mean_score, round(std_score, 6) as std_score, round(positive_ratio, 6) as positive_ratio,
  round(negative_ratio, 6) as negative_ratio, round(share_pct, 6) as share_pct"""


@query("entity_comparison", sql(f"select {CMP_COLS} from cmp", "obs", CMP))
def _(spark, sf):
    return rounded(A.entity_comparison(obs(spark, sf)))


@query(
    "yearly_mean",
    sql("select entity, cast(year(d) as int) as year, round(avg(score), 6) as mean_score from obs group by 1, 2", "obs"),
)
def _(spark, sf):
    return rounded(A.yearly_mean(obs(spark, sf), by=["entity"]))


@query(
    "yearly_trend",
    sql(
        """select entity, cast(min(y) as int) as first_year, cast(max(y) as int) as last_year, round(arg_min(m, y), 6) as first_mean,
          round(arg_max(m, y), 6) as last_mean, case when arg_max(m, y) > arg_min(m, y) then 'up' else 'down' end as direction,
          round(abs(arg_max(m, y) - arg_min(m, y)), 6) as magnitude
        from (select entity, year(d) as y, avg(score) as m from obs group by 1, 2) group by entity""",
        "obs",
    ),
)
def _(spark, sf):
    return rounded(A.yearly_trend(obs(spark, sf), by=["entity"]))


@query(
    "monthly_mean",
    sql(
        """select entity, cast(date_trunc('month', d) as date) as month, round(avg(score_mean), 6) as mean_score
        from daily group by 1, 2""",
        "daily",
    ),
)
def _(spark, sf):
    return rounded(A.monthly_mean(daily(spark, sf), value="score_mean"))


@query(
    "monthly_volatility",
    sql(
        """select entity, round(avg(s), 6) as volatility from (select entity, date_trunc('month', d) as m, stddev_samp(score) as s
        from obs group by 1, 2) group by entity""",
        "obs",
    ),
)
def _(spark, sf):
    return rounded(A.monthly_volatility(obs(spark, sf), by=["entity"]))


@query(
    "overview",
    sql(
        """select cast(sum(n) as bigint) as n, round(min(lo), 6) as min_score, round(max(hi), 6) as max_score, min(d) as first_day,
          max(d) as last_day, round(avg(n), 6) as items_per_day, (select round(avg(score), 6) from obs) as mean_score,
          (select round(stddev_samp(score), 6) from obs) as std_score
        from (select d, count(*) as n, min(score) as lo, max(score) as hi from obs group by d)""",
        "obs",
    ),
)
def _(spark, sf):
    return rounded(A.overview(obs(spark, sf)))


@query(
    "score_histogram",
    sql(
        """select e.entity, cast(b.bin as int) as bin, round(lo + b.bin * (hi - lo) / 30, 6) as bin_low,
          round(lo + (b.bin + 1) * (hi - lo) / 30, 6) as bin_high, coalesce(n, 0) as n, round(mean_value, 6) as mean_value
        from (select entity, min(score) as lo, max(score) as hi, avg(score) as mean_value from obs group by entity) e
        cross join (select unnest(range(30)) as bin) b
        left join (select o.entity, least(floor((score - lo) / (hi - lo) * 30), 29) as bin, count(*) as n from obs o
          join (select entity, min(score) as lo, max(score) as hi from obs group by entity) x on o.entity = x.entity group by 1, 2) c
          on c.entity = e.entity and c.bin = b.bin""",
        "obs",
    ),
)
def _(spark, sf):
    return rounded(A.histogram(obs(spark, sf), "score", 30, ["entity"]))


def _describe_sql(cols) -> str:
    parts = []
    for c in cols:
        for e in ("entity", "'ALL'"):
            parts.append(
                f"""select {e} as entity, '{c}' as "column", count({c}) as "count", avg({c}) as mean, stddev_samp({c}) as std,
                min({c}) as "min", max({c}) as "max", quantile_cont({c}, 0.25) as p25, quantile_cont({c}, 0.5) as p50,
                quantile_cont({c}, 0.75) as p75 from daily2 {'group by entity' if e == 'entity' else ''}"""
            )
    return " union all ".join(parts)


DAILY2 = "daily2 as (select entity, d, score_mean, score_std, cast(n_items as double) as n_items, positive_ratio from daily)"


@query(
    "describe_by_entity",
    sql(
        f"""select entity, "column", "count", round(mean, 6) as mean, round(std, 6) as std, round("min", 6) as "min",
        round("max", 6) as "max", round(p25, 6) as p25, round(p50, 6) as p50, round(p75, 6) as p75
        from ({_describe_sql(['score_mean', 'score_std', 'n_items', 'positive_ratio'])})""",
        "daily",
        DAILY2,
    ),
)
def _(spark, sf):
    return rounded(A.describe_by(daily(spark, sf), "entity", ["score_mean", "score_std", "n_items", "positive_ratio"]))


@query(
    "item_quantiles",
    sql(
        """select entity, 'score' as "column", round(quantile_cont(score, 0.01), 6) as p01, round(quantile_cont(score, 0.5), 6) as p50,
        round(quantile_cont(score, 0.99), 6) as p99 from obs group by entity""",
        "obs",
    ),
)
def _(spark, sf):
    return rounded(exact_percentiles(obs(spark, sf), ["entity"], ["score"], {"p01": 0.01, "p50": 0.5, "p99": 0.99}))


@query(
    "correlation_by_entity",
    sql(
        "select entity, round(corr(score_mean, positive_ratio), 6) as correlation, count(*) as n from daily group by entity",
        "daily",
    ),
)
def _(spark, sf):
    return rounded(A.corr_by(daily(spark, sf), ["entity"], "score_mean", "positive_ratio"))


CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(
    "correlation_matrix",
    " union all ".join(
        f'select \'{a}\' as "left", \'{b}\' as "right", round(corr({a}, {b}), 6) as correlation from lineitem'
        for i, a in enumerate(CORR_COLS)
        for b in CORR_COLS[i + 1 :]
    ),
)
def _(spark, sf):
    return rounded(A.corr_matrix(table(spark, sf, "lineitem"), CORR_COLS))


@query(
    "launch_summary",
    sql(
        """select entity, 'total' as dimension, 'ALL' as value, count(*) as n from launches group by 1
        union all select entity, 'year', cast(year(d) as varchar), count(*) from launches group by 1, 3
        union all select entity, 'category', category, count(*) from launches group by 1, 3""",
        "launches",
    ),
)
def _(spark, sf):
    return A.launch_summary(launches(spark, sf))


@query(
    "launch_calendar",
    sql(
        """select entity, cast(sum(n) as bigint) as n, min(lo) as first_day, max(hi) as last_day,
          cast(first(m order by n desc, m) as int) as peak_month, round(sum(n) / (year(max(hi)) - year(min(lo)) + 1), 6) as per_year
        from (select entity, month(d) as m, count(*) as n, min(d) as lo, max(d) as hi from launches group by 1, 2) group by entity""",
        "launches",
    ),
)
def _(spark, sf):
    return rounded(A.launch_calendar(launches(spark, sf)))


@query(
    "feature_groups",
    "select feature_group, count(*) as n, string_agg(feature, ',' order by feature) as members from ("
    + " union all ".join(
        f"select '{g}' as feature_group, feature from (select distinct o_orderpriority || '_' || f as feature from orders, "
        f"(values ('score_lag_1'), ('price_std_2'), ('n_items'), ('score_momentum_1')) v(f)) where regexp_matches(feature, '{'|'.join(fr)}')"
        for g, fr in FEATURE_GROUPS.items()
    )
    + ") group by feature_group",
)
def _(spark, sf):
    names = F.array(*[F.lit(f) for f in ("score_lag_1", "price_std_2", "n_items", "score_momentum_1")])
    features = (
        table(spark, sf, "orders")
        .select("o_orderpriority")
        .distinct()
        .select("o_orderpriority", F.explode(names).alias("f"))
        .select(F.concat("o_orderpriority", F.lit("_"), "f").alias("feature"))
    )
    return A.feature_groups(features, FEATURE_GROUPS)


# --- windows ---------------------------------------------------------------------------------------------------------


@query(
    "trailing_means",
    sql(
        f"""select entity, d, round(avg(score_mean) over ({WE} {rows(6)}), 6) as ma7, round(avg(score_mean) over ({WE} {rows(29)}), 6) as ma30,
          round(case when count(*) over ({WY} {rows(6)}) = 7 then avg(score_mean) over ({WY} {rows(6)}) end, 6) as ma7_year,
          round(case when count(*) over ({WY} {rows(3, 3)}) >= 3 then avg(score_mean) over ({WY} {rows(3, 3)}) end, 6) as centered_year,
          round(case when count(*) over ({WE} {rows(3, 3)}) = 7 then avg(score_mean) over ({WE} {rows(3, 3)}) end, 6) as centered_full
        from daily""",
        "daily",
    ),
)
def _(spark, sf):
    w, wy = W.series(["entity"]), W.series(["entity", F.year("d")])
    c = "score_mean"
    return daily(spark, sf).select(
        "entity",
        "d",
        r6(W.trailing_mean(c, 7, w)).alias("ma7"),
        r6(W.trailing_mean(c, 30, w)).alias("ma30"),
        r6(W.trailing_mean(c, 7, wy, 7)).alias("ma7_year"),
        r6(W.centered_mean(c, 7, wy, 3)).alias("centered_year"),
        r6(W.centered_mean(c, 7, w, 7)).alias("centered_full"),
    )


FILL = f"""coalesce(last_value(x ignore nulls) over ({WE} rows between unbounded preceding and current row),
  first_value(x ignore nulls) over ({WE} rows between current row and unbounded following))"""


def fill(x: str) -> str:
    return FILL.replace("(x ", f"({x} ")


GAPS = "gaps as (select entity, d, case when n_items > 1 then score_mean end as v from daily)"


@query(
    "fill_and_lag",
    sql(
        f"""select entity, d, round({fill('v')}, 6) as filled, round({fill('l1')}, 6) as lag_1, round({fill('l3')}, 6) as lag_3
        from (select *, lag(v, 1) over ({WE}) as l1, lag(v, 3) over ({WE}) as l3 from gaps)""",
        "daily",
        GAPS,
    ),
)
def _(spark, sf):
    w = W.series(["entity"])
    gaps = daily(spark, sf).select("entity", "d", F.when(F.col("n_items") > 1, F.col("score_mean")).alias("v"))
    return gaps.select(
        "entity",
        "d",
        r6(W.fill_both("v", w)).alias("filled"),
        r6(W.lag_filled("v", 1, w)).alias("lag_1"),
        r6(W.lag_filled("v", 3, w)).alias("lag_3"),
    )


@query(
    "momentum_and_volatility",
    sql(
        f"""select entity, d, round({fill('m1')}, 6) as momentum_1, round({fill('m4')}, 6) as momentum_4, round(df, 6) as change,
          round(s2, 6) as std_2, round(s3, 6) as std_3, round(cv, 6) as cv_4
        from (select *, close / lag(close) over w - 1 as m1, close / lag(close, 4) over w - 1 as m4, close - lag(close) over w as df,
          case when count(*) over ({WE} {rows(1)}) = 2 then stddev_samp(close) over ({WE} {rows(1)}) end as s2,
          case when count(*) over ({WE} {rows(2)}) >= 2 then stddev_samp(close) over ({WE} {rows(2)}) end as s3,
          case when count(*) over ({WE} {rows(3)}) = 4 then stddev_samp(close) over ({WE} {rows(3)}) / avg(close) over ({WE} {rows(3)}) end as cv
          from price window w as ({WE}))""",
        "price",
    ),
)
def _(spark, sf):
    w, c = W.series(["entity"]), "close"
    out = W.with_filled(price(spark, sf), {"momentum_1": W.momentum(c, 1, w), "momentum_4": W.momentum(c, 4, w)}, w)
    return rounded(
        out.select(
            "entity",
            "d",
            "momentum_1",
            "momentum_4",
            W.diff(c, w).alias("change"),
            W.rolling_std(c, 2, w).alias("std_2"),
            W.rolling_std(c, 3, w, 2).alias("std_3"),
            W.rolling_cv(c, 4, w).alias("cv_4"),
        )
    )


def s_rank(c: str, n: int = 4) -> str:
    lags = [f"lag({c}, {k}) over ({WE})" for k in range(n)]

    def tally(test: str) -> str:
        return " + ".join(f"case when {x} {test} then 1e0 else 0e0 end" for x in lags)

    less, same, present = tally(f"< {c}"), tally(f"= {c}"), tally("is not null")
    return f"case when {c} is not null then ({less} + ({same} + 1) / 2) / ({present}) end"


@query(
    "rank_and_cross",
    sql(
        f"""select entity, d, round({s_rank('close')}, 6) as pct_rank_4,
          cast(avg(close) over ({WE} {rows(1)}) > avg(close) over ({WE} {rows(3)}) as int) as cross_signal from price""",
        "price",
    ),
)
def _(spark, sf):
    w = W.series(["entity"])
    return price(spark, sf).select(
        "entity", "d", r6(W.rolling_pct_rank("close", 4, w)).alias("pct_rank_4"), W.ma_cross("close", w).alias("cross_signal")
    )


@query(
    "zscores_and_baselines",
    sql(
        """select entity, d, round((close - avg(close) over y) / stddev_pop(close) over y, 6) as zscore,
          round(close / avg(close) over y - 1, 6) as vs_year, round(close / avg(close) over e - 1, 6) as vs_overall,
          round(avg(close) over e, 6) as close_group_mean, round(stddev_samp(close) over e, 6) as close_group_std
        from price window y as (partition by entity, year(d)), e as (partition by entity)""",
        "price",
    ),
)
def _(spark, sf):
    year = ["entity", F.year("d")]
    return rounded(
        price(spark, sf).withColumns(
            {
                "zscore": W.zscore_by("close", year),
                "vs_year": W.relative_to_mean("close", year),
                "vs_overall": W.relative_to_mean("close", ["entity"]),
                **W.group_stats("close", ["entity"]),
            }
        ).drop("close", "vol")
    )


@query(
    "volume_features",
    sql(
        f"""select entity, d, round(n_items / lag(n_items) over ({WE}) - 1, 6) as volume_momentum,
          cast(n_items > q as int) as volume_spike
        from daily join (select entity as e, quantile_cont(n_items, 0.9) as q from daily group by entity) on entity = e""",
        "daily",
    ),
)
def _(spark, sf):
    return rounded(W.volume_features(daily(spark, sf), "n_items", ["entity"]).select("entity", "d", "volume_momentum", "volume_spike"))


@query(
    "risk_ratios",
    sql(
        f"""select entity, round(min(dd), 6) as max_drawdown, round(avg(r) * 252, 6) as annual_return,
          round(avg(r) / stddev_samp(r) * sqrt(252), 6) as sharpe, round(avg(r - m) / stddev_samp(r - m) * sqrt(252), 6) as information_ratio,
          round(avg(r) * 252 / abs(min(dd)), 6) as calmar
        from path join (select d as day, avg(r) as m from path group by d) on d = day group by entity""",
        "price",
        f"""path as (select entity, d, close / lag(close) over ({WE}) - 1 as r,
          close / max(close) over ({WE} rows unbounded preceding) - 1 as dd from price)""",
    ),
)
def _(spark, sf):
    return rounded(W.risk_ratios(price(spark, sf), "close", ["entity"]))


@query(
    "event_lanes",
    sql(
        f"""select event_id, entity, d, category, cast(row_number() over (partition by l.entity, l.d order by event_id) - 1
          + cast(near as int) as int) as lane
        from launches l join (select entity as e, d as day, coalesce(d - lag(d) over ({WY}) < 15, false) as near
          from (select distinct entity, d from launches)) on entity = e and d = day""",
        "launches",
    ),
)
def _(spark, sf):
    events = launches(spark, sf).withColumn("year", F.year("d"))
    return W.event_lanes(events, ["entity", "year"]).drop("year")


@query(
    "chart_series",
    sql(
        f"""select coalesce(s.entity, p.entity) as entity, coalesce(s.d, p.d) as d, round(ma, 6) as score_ma7, round(close, 6) as close,
          cast(year(coalesce(s.d, p.d)) as int) as year
        from (select entity, d, case when count(*) over ({WY} {rows(6)}) = 7 then avg(score_mean) over ({WY} {rows(6)}) end as ma from daily) s
        full join price p on s.entity = p.entity and s.d = p.d""",
        "daily",
        "price",
    ),
)
def _(spark, sf):
    return rounded(chart_series(obs(spark, sf), price(spark, sf)))


@query("smoothed_price", sql("select entity, d, round(close, 6) as close from smooth", "smooth"))
def _(spark, sf):
    return rounded(smoothed_price(price(spark, sf)))


# --- sets, limits, spines --------------------------------------------------------------------------------------------


@query(
    "last_90_days",
    sql(
        f"""select entity, d, round(score_mean, 6) as score_mean from (select *, row_number() over (partition by entity order by d desc) as rn
        from daily) where rn <= 90""",
        "daily",
    ),
)
def _(spark, sf):
    return rounded(S.last_rows(daily(spark, sf), 90, ["entity"]).select("entity", "d", "score_mean"))


@query(
    "latest_values",
    sql("select entity, round(arg_max(score_mean, d), 6) as score_mean, max(d) as d from daily group by entity", "daily"),
)
def _(spark, sf):
    return rounded(S.latest(daily(spark, sf), "score_mean", ["entity"]))


@query(
    "sorted_series",
    sql("select entity, d, round(score_mean, 6) as score_mean from daily order by entity, d", "daily"),
)
def _(spark, sf):
    return rounded(daily(spark, sf).select("entity", "d", "score_mean")).orderBy("entity", "d")


@query(
    "union_of_tables",
    """select 'orders' as src, cast(o_orderdate as date) as d, o_totalprice as amount, cast(null as double) as tax from orders
    union all select 'lineitem', cast(l_shipdate as date), l_extendedprice, l_tax from lineitem""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.lit("orders").alias("src"), F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").alias("amount"))
    li = table(spark, sf, "lineitem").select(
        F.lit("lineitem").alias("src"), F.to_date("l_shipdate").alias("d"), F.col("l_extendedprice").alias("amount"), F.col("l_tax").alias("tax")
    )
    return S.union_all([o, li])


@query(
    "tagged_analyses",
    sql(
        """select 'comparison' as analysis, 'items' as source, entity as key, 'mean_score' as metric, round(mean_score, 6) as value from cmp
        union all select 'comparison', 'items', entity, 'n', cast(n as double) from cmp
        union all select 'latest', 'daily', entity, 'score_mean', round(arg_max(score_mean, d), 6) from daily group by entity""",
        "daily",
        CMP,
    ),
)
def _(spark, sf):
    items = obs(spark, sf)
    parts = {
        ("comparison", "items"): A.entity_comparison(items),
        ("latest", "daily"): S.latest(daily(spark, sf), "score_mean", ["entity"]),
    }
    return rounded(S.union_tagged(parts, "entity", ["mean_score", "n", "score_mean"]))


@query(
    "future_days",
    sql(
        """select entity, cast(last + cast(step as integer) as date) as d, cast(step as int) as step
        from (select entity, max(d) as last, unnest(range(1, 31)) as step from daily group by entity)""",
        "daily",
    ),
)
def _(spark, sf):
    return S.future_spine(daily(spark, sf), 30, ["entity"])


@query(
    "calendar_gaps",
    sql(
        """select entity, cast(max(d) - min(d) + 1 as bigint) as n_calendar, count(*) as n_present from daily group by entity""",
        "daily",
    ),
)
def _(spark, sf):
    days = daily(spark, sf).select("entity", "d")
    full = S.calendar(days, ["entity"]).join(days.withColumn("here", F.lit(1)), ["entity", "d"], "left")
    return full.groupBy("entity").agg(F.count(F.lit(1)).alias("n_calendar"), F.count("here").alias("n_present"))


@query(
    "numbered_rows",
    sql("select entity, d, row_number() over (order by d, entity) as rn from daily", "daily"),
)
def _(spark, sf):
    return S.numbered(daily(spark, sf).select("entity", "d"), "d", ["entity"])


@query(
    "kept_entities",
    sql("select entity, count(*) as n from obs where entity in (select n_p from big) group by entity", "obs",
        "big as (select entity as n_p from obs group by entity having count(*) > 3000)"),
)
def _(spark, sf):
    items = obs(spark, sf)
    return S.keep_entities(items, S.eligible_entities(items, 3000)).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "eligible_entities",
    sql("select publisher as entity, count(*) as n_rows from articles group by publisher having count(*) > 45", "articles"),
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("entity"))
    return S.eligible_entities(docs, 45)


# --- rules over the comparison ---------------------------------------------------------------------------------------


@query(
    "insight_gaps",
    sql(
        """select entity as winner, other as runner_up, round(mean_score - m, 6) as gap from (select entity, mean_score,
          lead(entity) over w as other, lead(mean_score) over w as m from cmp window w as (order by mean_score desc, entity))
        where other is not null""",
        "obs",
        CMP,
    ),
)
def _(spark, sf):
    return rounded(R.insight_gap(A.entity_comparison(obs(spark, sf))))


@query("insight_volatile", sql(f"select {CMP_COLS} from cmp where std_score > 0.5", "obs", CMP))
def _(spark, sf):
    return rounded(R.insight_volatile(A.entity_comparison(obs(spark, sf))))


