"""Queries joining daily series with prices and events, feature tables, lags and event studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from newstide.catalog.bindings import daily, launches, obs, price, sql
from newstide.catalog.registry import query, r6, rounded
from newstide.catalog.series_queries import WE, WY, fill, rows, s_rank
from newstide.functions.scores import finite
from newstide.functions.significance import bonferroni, corr_p_value
from newstide.operators import aggregates as A
from newstide.operators import asof as J
from newstide.operators import forecast as P
from newstide.operators import impact as I
from newstide.operators import sets as S
from newstide.operators.blocks import correlations
from newstide.operators.lag import best_lag, lag_correlation
from newstide.operators.rules import early_warning, successful_launches
from newstide.operators.sets import top_bottom
from newstide.operators.skew import stored
from newstide.operators.windows import fill_forward, momentum, series
from newstide.plans.series import feature_table, smoothed_price


@query(
    "daily_with_price",
    sql(
        """select s.entity, s.d, round(score_mean, 6) as score_mean, n_items, round(close, 6) as close
        from daily s left join price p on s.entity = p.entity and s.d = p.d""",
        "daily",
        "price",
    ),
)
def _(spark, sf):
    joined = J.join_daily(daily(spark, sf).select("entity", "d", "score_mean", "n_items"), price(spark, sf).drop("vol"))
    return rounded(joined)


ASOF = """withp as (select s.entity, s.d, s.n_items, p.close as raw from daily s
  asof left join (select * from smooth where close is not null) p
  on s.entity = p.entity and year(s.d) = year(p.d) and s.d >= p.d)"""


@query(
    "asof_price",
    sql(f"select entity, d, n_items, round(raw, 6) as raw, round({fill('raw')}, 6) as close from withp", "daily", "smooth", ASOF),
)
def _(spark, sf):
    spine = daily(spark, sf).select("entity", "d", "n_items")
    got = J.asof_price(spine, smoothed_price(price(spark, sf))).withColumn("raw", F.col("close"))
    return rounded(J.filled_price(got, ["close"]))


DIST = """dist as (select s.entity, s.d, coalesce(min(e.d) filter (where e.d > s.d) - s.d, 365) as days_to_next,
  coalesce(s.d - max(e.d) filter (where e.d <= s.d), 365) as days_since_last
  from (select entity, d from daily) s left join (select distinct entity, d from launches) e on s.entity = e.entity group by 1, 2)"""
REACH = """reach as (select s.entity, s.d, count(e.d) as events_nearby, coalesce(sum(exp(-abs(e.d - s.d) / 30e0)), 0) as event_impact
  from (select entity, d from daily) s left join launches e on s.entity = e.entity and abs(e.d - s.d) <= 60 group by 1, 2)"""


@query(
    "event_distance",
    sql("select entity, d, cast(days_to_next as int) as days_to_next, cast(days_since_last as int) as days_since_last from dist", "daily", "launches", DIST),
)
def _(spark, sf):
    return J.event_distance(daily(spark, sf).select("entity", "d"), launches(spark, sf))


@query("event_reach", sql("select entity, d, events_nearby, round(event_impact, 6) as event_impact from reach", "daily", "launches", REACH))
def _(spark, sf):
    return rounded(J.with_event_reach(daily(spark, sf).select("entity", "d"), launches(spark, sf)))


@query(
    "event_proximity",
    sql(
        """select entity, d, round(1e0 / (1 + least(days_to_next, days_since_last)), 6) as event_proximity,
        cast(days_to_next <= 30 as int) as pre_event, cast(days_since_last <= 30 as int) as post_event from dist""",
        "daily",
        "launches",
        DIST,
    ),
)
def _(spark, sf):
    reach = J.event_distance(daily(spark, sf).select("entity", "d"), launches(spark, sf))
    near = J.proximity_columns(F.col("days_to_next"), F.col("days_since_last"))
    return rounded(reach.select("entity", "d", *[c.alias(n) for n, c in near.items()]))


# Every day with items and the last price up to it; days before the first price of an entity get that one.
PRICED = f"""dayp as (select s.entity, s.d, s.score_mean, s.n_items, p.close as raw from daily s
    asof left join price p on s.entity = p.entity and year(s.d) = year(p.d) and s.d >= p.d),
  priced as (select entity, d, score_mean, n_items, {fill('raw')} as close from dayp)"""
VALUES = f"""vals as (select entity, d, case when count(score_mean) over w = 7 then avg(score_mean) over w end as score,
    case when count(n_items) over w = 7 then avg(n_items) over w end as n_items, case when count(close) over w = 7 then avg(close) over w end as close
  from priced window w as ({WE} {rows(3, 3)}))"""
EW = """ew as (select e.entity, e.d as event_day, case when v.d < e.d then 'pre' else 'post' end as phase, v.score, v.close, v.n_items
  from (select distinct entity, d from launches) e join vals v on e.entity = v.entity and v.d between e.d - 28 and e.d + 28)"""


def _priced(spark, sf):
    spine = daily(spark, sf).select("entity", "d", "score_mean", "n_items")
    return J.filled_price(J.asof_price(spine, price(spark, sf).select("entity", "d", "close")), ["close"])


def _study_values(spark, sf):
    """All days with items and their price as of that day, smoothed along those days."""
    return I.smoothed(_priced(spark, sf).withColumnRenamed("score_mean", "score"))


@query(
    "event_windows",
    sql(
        """select entity, event_day, phase, count(*) as n, round(avg(score), 6) as score, round(avg(close), 6) as close
        from ew group by 1, 2, 3""",
        "daily",
        "price",
        "launches",
        PRICED,
        VALUES,
        EW,
    ),
)
def _(spark, sf):
    windows = J.event_windows(launches(spark, sf), _study_values(spark, sf))
    return rounded(
        windows.groupBy("entity", "event_day", "phase").agg(
            F.count(F.lit(1)).alias("n"), F.avg("score").alias("score"), F.avg("close").alias("close")
        )
    )


# Two-sided Student tail for whole degrees of freedom: the finite trigonometric series, summed over a list.
def s_tail(t: str, df: str) -> str:
    cos2 = f"({df} / ({df} + {t} * {t}))"
    theta = f"atan(abs({t}) / sqrt({df}))"
    odd = (
        f"1 - 2 / pi() * ({theta} + case when {df} > 1 then sin({theta}) * cos({theta}) * (1 + list_sum(list_transform("
        f"range(1, cast(({df} - 1) / 2 as bigint)), lambda k: list_product(list_transform(range(1, k + 1), lambda i: 2e0 * i / (2 * i + 1) * {cos2})))::double[])) else 0 end)"
    )
    even = (
        f"1 - sin({theta}) * (1 + list_sum(list_transform(range(1, cast({df} / 2 as bigint)), "
        f"lambda k: list_product(list_transform(range(1, k + 1), lambda i: (2e0 * i - 1) / (2 * i) * {cos2})))::double[]))"
    )
    fix = "coalesce"
    odd = odd.replace("list_sum(", f"{fix}(list_sum(").replace("::double[])", "::double[]), 0)")
    even = even.replace("list_sum(", f"{fix}(list_sum(").replace("::double[])", "::double[]), 0)")
    return f"case when {t} is null or {df} <= 0 then null when cast({df} as bigint) % 2 = 1 then {odd} else {even} end"


STATS = """stats as (select entity, event_day, avg(score) filter (where phase = 'pre') as m1, avg(score) filter (where phase = 'post') as m2,
   var_samp(score) filter (where phase = 'pre') as v1, var_samp(score) filter (where phase = 'post') as v2,
   cast(count(score) filter (where phase = 'pre') as double) as n1, cast(count(score) filter (where phase = 'post') as double) as n2,
   avg(close) filter (where phase = 'pre') as p1, avg(close) filter (where phase = 'post') as p2,
   avg(n_items) filter (where phase = 'pre') as c1, avg(n_items) filter (where phase = 'post') as c2 from ew group by 1, 2),
 tests as (select *, n1 + n2 - 2 as df, (m1 - m2) / nullif(sqrt(((n1 - 1) * coalesce(v1, 0) + (n2 - 1) * coalesce(v2, 0)) / nullif(n1 + n2 - 2, 0)
   * (1 / nullif(n1, 0) + 1 / nullif(n2, 0))), 0) as t from stats),
 study as (select event_id, l.entity, l.d as event_day, category, m2 - m1 as score_change, 100 * (p2 / nullif(p1, 0) - 1) as price_change_pct,
   c2 - c1 as items_change, cast(coalesce(n1 + n2, 0) as bigint) as sample_size, t, df, pv, coalesce(pv < 0.05, false) as significant
   from launches l left join (select *, TAIL as pv from tests) tests on l.entity = tests.entity and l.d = event_day)""".replace("TAIL", s_tail("t", "df"))
STUDY = ("daily", "price", "launches", PRICED, VALUES, EW, STATS)


def _study(spark, sf):
    return I.event_study(launches(spark, sf), _study_values(spark, sf))


@query(
    "event_study",
    sql(
        """select event_id, entity, event_day, category, round(score_change, 6) + 0e0 as score_change,
        round(price_change_pct, 6) + 0e0 as price_change_pct, round(items_change, 6) + 0e0 as items_change, sample_size, round(t, 6) as t_statistic, round(pv, 6) as p_value, significant from study""",
        *STUDY,
    ),
)
def _(spark, sf):
    return rounded(
        _study(spark, sf).select(
            "event_id",
            "entity",
            "event_day",
            "category",
            "score_change",
            "price_change_pct",
            "items_change",
            "sample_size",
            "t_statistic",
            "p_value",
            "significant",
        )
    )


@query(
    "impact_by_category",
    sql(
        """select category, count(*) as n, round(avg(score_change), 6) as score_change_mean, round(stddev_samp(score_change), 6) as score_change_std,
          round(avg(price_change_pct), 6) as price_change_mean, round(stddev_samp(price_change_pct), 6) as price_change_std,
          round(avg(case when significant then 1e0 else 0e0 end), 6) as significant_rate from study group by category""",
        *STUDY,
    ),
)
def _(spark, sf):
    return rounded(A.impact_by_category(_study(spark, sf)))


@query(
    "impact_summary",
    sql(
        """select count(*) as n_events, cast(count(*) filter (where significant) as bigint) as n_significant,
          round(avg(score_change), 6) as score_change_mean, round(avg(price_change_pct), 6) as price_change_mean,
          (select string_agg(category || '=' || n, ',' order by category) from (select category, count(*) as n from study group by 1))
            as category_breakdown from study""",
        *STUDY,
    ),
)
def _(spark, sf):
    one = A.impact_summary(_study(spark, sf))
    cells = F.transform(F.map_entries("category_breakdown"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return rounded(one.withColumn("category_breakdown", F.concat_ws(",", cells)))


@query(
    "top_and_bottom_impact",
    sql(
        """select event_id, entity, round(score_change, 6) as score_change, cast(row_number() over (order by score_change desc, event_id) as int) as "rank",
          'top' as side from study where score_change is not null qualify row_number() over (order by score_change desc, event_id) <= 3
        union all select event_id, entity, round(score_change, 6), cast(row_number() over (order by score_change, event_id) as int), 'bottom'
        from study where score_change is not null qualify row_number() over (order by score_change, event_id) <= 3""",
        *STUDY,
    ),
)
def _(spark, sf):
    ends = top_bottom(_study(spark, sf).select("event_id", "entity", "score_change"), "score_change", "event_id")
    return rounded(ends)


@query("successful_launches", sql("select event_id, entity, event_day, round(score_change, 6) as score_change from study where score_change > 0.1", *STUDY))
def _(spark, sf):
    return rounded(successful_launches(_study(spark, sf)).select("event_id", "entity", "event_day", "score_change"))


LAGS = range(-21, 22)
# Every calendar day between an entity's first and last, so that a lag is a number of days.
TWO = f"""spine as (select entity, cast(unnest(generate_series(min(d), max(d), interval 1 day)) as date) as d from daily group by entity),
  spinep as (select s.entity, s.d, p.close as raw from spine s asof left join price p on s.entity = p.entity and year(s.d) = year(p.d) and s.d >= p.d),
  filledp as (select entity, d, {fill('raw')} as close from spinep),
  two as (select f.entity, f.d, score_mean as x, close as y, close / lag(close) over (partition by f.entity order by f.d) - 1 as r
    from filledp f left join daily s on s.entity = f.entity and s.d = f.d)"""
LAGGED = "lagged as (" + " union all ".join(
    f"select entity, {k} as lag_days, corr(x, y) as correlation_price, corr(x, r) as correlation_return from "
    f"(select entity, y, r, lag(x, {k}) over ({WE}) as x from two) group by entity"
    for k in LAGS
) + ")"


def _lag_table(spark, sf):
    days = daily(spark, sf).select("entity", "d", "score_mean")
    spine = S.calendar(days, ["entity"]).join(days, ["entity", "d"], "left")
    prices = price(spark, sf).select("entity", "d", "close")
    return lag_correlation(J.filled_price(J.asof_price(spine, prices), ["close"]), "score_mean", "close")


@query(
    "lag_correlation",
    sql(
        """select entity, lag_days, round(correlation_price, 6) as correlation_price, round(correlation_return, 6) as correlation_return
        from lagged""",
        "daily",
        "price",
        TWO,
        LAGGED,
    ),
)
def _(spark, sf):
    return rounded(_lag_table(spark, sf))


@query(
    "best_lag",
    sql(
        """select entity, first(lag_days order by abs(correlation_price) desc, abs(lag_days), lag_days) as lag_days,
          round(first(correlation_price order by abs(correlation_price) desc, abs(lag_days), lag_days), 6) as max_correlation
        from lagged group by entity""",
        "daily",
        "price",
        TWO,
        LAGGED,
    ),
)
def _(spark, sf):
    return rounded(best_lag(_lag_table(spark, sf)))


@query(
    "lag_join_correlation",
    sql(
        """select a.entity, cast(k as int) as lag, count(*) as n, round(corr(score_mean, close), 6) as correlation
        from (select entity, d, score_mean, unnest(range(-21, 22)) as k from daily) a join price p
          on a.entity = p.entity and p.d = a.d + cast(k as integer) group by 1, 2""",
        "daily",
        "price",
    ),
)
def _(spark, sf):
    pairs = J.lag_join(daily(spark, sf).select("entity", "d", "score_mean"), price(spark, sf))
    return rounded(pairs.groupBy("entity", "lag").agg(F.count(F.lit(1)).alias("n"), F.corr("score_mean", "close").alias("correlation")))


@query(
    "correlation_significance",
    sql(
        f"""select entity, n, round(r, 6) as r, round(p, 6) as p_value, round(least(5 * p, 1), 6) as p_bonferroni
        from (select *, {s_tail('t', 'df')} as p from (select *, cast(n - 2 as double) as df, r * sqrt((n - 2) / (1 - r * r)) as t from
          (select entity, count(*) as n, corr(score_mean, close) as r from priced group by entity)))""",
        "daily",
        "price",
        PRICED,
    ),
)
def _(spark, sf):
    both = _priced(spark, sf)
    table = A.corr_by(both, ["entity"], "score_mean", "close").withColumnRenamed("correlation", "r")
    tests = table.withColumn("p_value", corr_p_value(F.col("r"), F.col("n")))
    return rounded(tests.withColumn("p_bonferroni", bonferroni(F.col("p_value"), table.agg(F.count(F.lit(1))).scalar())))


AHEAD = 7  # rows that a warning looks ahead


def _ahead_sql() -> str:
    path = "score_mean"
    for _ in range(AHEAD):
        path = f"a + b * ({path})"
    return path


ROLLING = f"""pairs as (select *, lag(score_mean) over ({WE}) as x from priced),
 fits as (select entity, d, score_mean, close, regr_intercept(score_mean, x) over known as a, regr_slope(score_mean, x) over known as b,
   regr_count(score_mean, x) over known as n_pairs from pairs window known as (partition by entity order by d rows between unbounded preceding and current row)),
 ahead as (select *, case when n_pairs >= 30 then {_ahead_sql()} end as predicted from fits)"""


@query(
    "rolling_forecast",
    sql(
        "select entity, d, cast(n_pairs as bigint) as n_pairs, round(score_mean, 6) as score_mean, round(predicted, 6) as predicted from ahead",
        "daily",
        "price",
        PRICED,
        ROLLING,
    ),
)
def _(spark, sf):
    """What the series up to each day foretells for a week later."""
    rolled = P.rolling_ar1(_priced(spark, sf), "score_mean", AHEAD)
    return rounded(rolled.select("entity", "d", "n_pairs", "score_mean", "predicted"))


@query(
    "early_warning",
    sql(
        f"""select entity, d, case when pc < -0.02 and sd > 0.3 then 3 when sd > 0.3 then 2 when pc < -0.02 then 1 else 0 end as level
        from (select entity, d, close / lag(close) over ({WE}) - 1 as pc, score_mean - predicted as sd from ahead)""",
        "daily",
        "price",
        PRICED,
        ROLLING,
    ),
)
def _(spark, sf):
    """Level 2 stands on the fall that the series up to that day predicts."""
    rolled = P.rolling_ar1(_priced(spark, sf), "score_mean", AHEAD)
    table = rolled.withColumns({"price_change": momentum("close", 1, series(["entity"])), "score_drop": F.col("score_mean") - F.col("predicted")})
    return early_warning(table, "price_change", "score_drop").select("entity", "d", "level")


def _feature_sql() -> str:
    """The whole feature table, stage by stage."""
    fwd = f"last_value(price ignore nulls) over ({WE} rows between unbounded preceding and current row)"

    def mom(c: str, k: int) -> str:
        return f"{c} / nullif(lag({c}, {k}) over ({WE}), 0) - 1"

    def std(c: str, n: int, m: int) -> str:
        return f"case when count({c}) over ({WE} {rows(n - 1)}) >= {m} then stddev_samp({c}) over ({WE} {rows(n - 1)}) end"

    def z(c: str) -> str:
        return f"({c} - avg({c}) over yr) / nullif(stddev_pop({c}) over yr, 0)"

    def rel(c: str, w: str) -> str:
        return f"{c} / nullif(avg({c}) over {w}, 0) - 1"

    gaps = {
        "price_momentum_1": mom("ff", 1),
        "price_momentum_2": mom("ff", 2),
        "price_momentum_4": mom("ff", 4),
        "price_std_2": std("price", 2, 2),
        "price_std_3": std("price", 3, 2),
        "price_zscore": z("price"),
        "price_pct_rank_4": s_rank("price"),
        "price_vs_year": rel("price", "yr"),
        "price_vs_overall": rel("price", "en"),
        "score_momentum_1": mom("score", 1),
        "score_momentum_2": mom("score", 2),
        "score_momentum_4": mom("score", 4),
        "score_std_2": std("score", 2, 2),
        "score_std_3": std("score", 3, 2),
        "score_zscore": z("score"),
        "score_diff": f"score - lag(score) over ({WE})",
        "score_pct_rank_4": s_rank("score"),
        "score_cv_4": f"({std('score', 4, 2)}) / avg(score) over ({WE} {rows(3)})",
        "score_vs_year": rel("score", "yr"),
        "score_vs_overall": rel("score", "en"),
        "volume_momentum": mom("n_items", 1),
    }
    lags = {"price_lag_1": ("price", 1), "price_lag_2": ("price", 2), **{f"score_lag_{k}": ("score", k) for k in (1, 2, 3)}}
    late = {"score_momentum_lag_1": 1, "score_momentum_lag_2": 2}
    w = "window yr as (partition by entity, year(d)), en as (partition by entity)"
    stages = [
        "daily",
        "smooth",
        "launches",
        DIST,
        REACH,
        f"""base0 as (select entity, d, n_items, case when count(*) over ({WY} {rows(3, 3)}) >= 3 then avg(score_mean) over ({WY} {rows(3, 3)}) end as score
          from daily)""",
        f"base as (select entity, d, n_items, {fill('score')} as score from base0)",
        """priced as (select s.*, p.close as price from base s asof left join (select * from smooth where close is not null) p
          on s.entity = p.entity and year(s.d) = year(p.d) and s.d >= p.d)""",
        f"forward as (select *, {fwd} as ff from priced)",
        "raw as (select *, " + ", ".join(f"{e} as {n}" for n, e in gaps.items())
        + ", " + ", ".join(f"lag({c}, {k}) over ({WE}) as {n}" for n, (c, k) in lags.items())
        + f", cast(coalesce(avg(price) over ({WE} {rows(1)}) > avg(price) over ({WE} {rows(3)}), false) as int) as price_ma_cross"
        + f", cast(n_items > quantile_cont(n_items, 0.9) over en as int) as volume_spike from forward {w})",
        "filled as (select entity, d, n_items, score, price_ma_cross, volume_spike, "
        + ", ".join(f"{fill(n)} as {n}" for n in (*gaps, *lags, "price")) + " from raw)",
        "late as (select *, " + ", ".join(f"lag(score_momentum_1, {k}) over ({WE}) as {n}" for n, k in late.items()) + " from filled)",
        "flat as (select * exclude (" + ", ".join(late) + "), " + ", ".join(f"{fill(n)} as {n}" for n in late) + """,
          month(d) as mo, quarter(d) as qu from late)""",
        """joined as (select f.*, days_to_next, days_since_last, events_nearby, event_impact, score * price_momentum_1 as spm
          from flat f join dist using (entity, d) join reach using (entity, d))""",
    ]
    numbers = [*gaps, *lags, *late, "price", "score", "event_impact"]
    body = "select entity, d, n_items, price_ma_cross, volume_spike, " + ", ".join(f"round({n}, 6) as {n}" for n in numbers) + f""",
      cast(year(d) as int) as year, cast(mo as int) as month, cast(qu as int) as quarter, cast(dayofyear(d) as int) as day_of_year,
      cast(week(d) as int) as week_of_year,
      cast(mo in (3, 6, 9, 12) as int) as is_quarter_end, cast(mo = 12 as int) as is_year_end, cast(mo in (9, 10, 11) as int) as is_season,
      round(sin(2 * pi() * mo / 12), 6) + 0e0 as month_sin, round(cos(2 * pi() * mo / 12), 6) + 0e0 as month_cos,
      round(sin(2 * pi() * qu / 4), 6) + 0e0 as quarter_sin, round(cos(2 * pi() * qu / 4), 6) + 0e0 as quarter_cos,
      cast(days_to_next as int) as days_to_next, cast(days_since_last as int) as days_since_last, events_nearby,
      round(1e0 / (1 + least(days_to_next, days_since_last)), 6) as event_proximity,
      cast(days_to_next <= 30 as int) as pre_event, cast(days_since_last <= 30 as int) as post_event,
      round(score / nullif(price, 0), 6) as score_price_ratio, round(spm, 6) as score_price_momentum, round(n_items * score, 6) as items_score,
      round(n_items * event_impact, 6) as items_impact, round(qu * event_impact, 6) as quarter_impact,
      round(cast(mo in (9, 10, 11) as int) * score, 6) as season_score,
      round(coalesce(last_value(spm ignore nulls) over ({WE} rows between unbounded preceding and 1 preceding),
        first_value(spm ignore nulls) over ({WE} rows between unbounded preceding and unbounded following)), 6) as score_price_momentum_lag
      from joined"""
    return sql(body, *stages)


def _features(spark, sf):
    out = rounded(feature_table(obs(spark, sf), price(spark, sf), launches(spark, sf)))
    zero = ["month_sin", "month_cos", "quarter_sin", "quarter_cos"]
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c in zero})


@query("feature_table", _feature_sql())
def _(spark, sf):
    return _features(spark, sf)


FEATURE_NUMBERS = """
    n_items price_ma_cross volume_spike price_momentum_1 price_momentum_2 price_momentum_4 price_std_2 price_std_3 price_zscore price_pct_rank_4
    price_vs_year price_vs_overall score_momentum_1 score_momentum_2 score_momentum_4 score_std_2 score_std_3 score_zscore score_diff score_pct_rank_4
    score_cv_4 score_vs_year score_vs_overall volume_momentum price_lag_1 price_lag_2 score_lag_1 score_lag_2 score_lag_3 score_momentum_lag_1
    score_momentum_lag_2 price score event_impact year month quarter day_of_year week_of_year is_quarter_end is_year_end is_season month_sin month_cos
    quarter_sin quarter_cos days_to_next days_since_last events_nearby event_proximity pre_event post_event score_price_ratio score_price_momentum
    items_score items_impact quarter_impact season_score score_price_momentum_lag
""".split()


def _feature_correlation_sql() -> str:
    """All pairs of the feature table's numbers, stacked from one row of aggregates."""
    pairs = [(a, b) for i, a in enumerate(FEATURE_NUMBERS) for b in FEATURE_NUMBERS[i + 1 :]]
    cells = ", ".join(f"""{{'l': '{a}', 'r': '{b}', 'c': corr({a}, {b}), 'n': count({a} + {b})}}""" for a, b in pairs)
    return f"""select c.l as "left", c.r as "right", round(case when isfinite(c.c) then c.c end, 6) + 0e0 as correlation, c.n as n
      from (select unnest([{cells}]) as c from ({_feature_sql()}))"""


@query("feature_correlation", _feature_correlation_sql())
def _(spark, sf):
    """Pearson correlation of all pairs of features."""
    table = stored(_features(spark, sf), "features")
    return rounded(correlations(table, FEATURE_NUMBERS))


@query(
    "price_interactions",
    sql(
        f"""select entity, d, round(score_mean / nullif(close, 0), 6) as score_price_ratio,
          round(score_mean * (close / lag(close) over ({WE}) - 1), 6) as score_price_momentum,
          round(last_value(close) over ({WE} rows between unbounded preceding and current row), 6) as close
        from priced""",
        "daily",
        "price",
        PRICED,
    ),
)
def _(spark, sf):
    w = series(["entity"])
    both = _priced(spark, sf)
    return both.select(
        "entity",
        "d",
        r6(finite(F.try_divide("score_mean", "close"))).alias("score_price_ratio"),
        r6(F.col("score_mean") * momentum("close", 1, w)).alias("score_price_momentum"),
        r6(fill_forward("close", w)).alias("close"),
    )
