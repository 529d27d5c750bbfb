"""Windows, fills, as-of joins, events, quantiles, lags against pandas or brute force."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from newstide.functions.significance import corr_p_value, t_p_value
from newstide.operators import aggregates as A
from newstide.operators import asof as J
from newstide.operators import windows as W
from newstide.operators.impact import event_study, pooled_t_test
from newstide.operators.lag import best_lag, lag_correlation
from newstide.operators.quantiles import exact_percentiles
from newstide.operators.sets import numbered, numbered_in_groups, top_bottom

DAY = dt.date(2021, 11, 20)


@pytest.fixture(scope="module")
def walk():
    rnd = random.Random(5)
    rows = []
    for e in ("a", "b"):
        for i in range(120):
            if rnd.random() < 0.85:
                rows.append((e, DAY + dt.timedelta(days=i), None if rnd.random() < 0.2 or i < 3 else round(rnd.uniform(1, 5), 3)))
    return pd.DataFrame(rows, columns=["entity", "d", "v"])


def as_spark(spark, pdf):
    rows = [tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "entity string, d date, v double")


def test_windows_match_pandas(spark, walk):
    w = W.series(["entity"])
    got = (
        as_spark(spark, walk)
        .select(
            "entity",
            "d",
            W.trailing_mean("v", 7, w).alias("ma"),
            W.trailing_mean("v", 7, w, 7).alias("ma_full"),
            W.centered_mean("v", 7, w, 3).alias("mid"),
            W.rolling_std("v", 3, w, 2).alias("sd"),
            W.rolling_pct_rank("v", 4, w).alias("rank"),
            W.fill_both("v", w).alias("fill"),
            W.lag_filled("v", 2, w).alias("lag"),
            W.diff("v", w).alias("diff"),
        )
        .orderBy("entity", "d")
        .toPandas()
    )
    g = walk.groupby("entity")["v"]
    want = {
        "ma": g.transform(lambda s: s.rolling(7, min_periods=1).mean()),
        "ma_full": g.transform(lambda s: s.rolling(7).mean()),
        "mid": g.transform(lambda s: s.rolling(7, center=True, min_periods=3).mean()),
        "sd": g.transform(lambda s: s.rolling(3, min_periods=2).std()),
        "rank": g.transform(lambda s: s.rolling(4, min_periods=1).rank(pct=True)),
        "fill": g.transform(lambda s: s.ffill().bfill()),
        "lag": g.transform(lambda s: s.shift(2).ffill().bfill()),
        "diff": g.transform(lambda s: s.diff()),
    }
    for name, series in want.items():
        np.testing.assert_allclose(got[name].to_numpy(float), series.to_numpy(float), rtol=1e-9, err_msg=name)


def test_asof_stays_inside_the_year(spark):
    spine = spark.createDataFrame([("a", DAY + dt.timedelta(days=i), i) for i in range(60)], "entity string, d date, i int")
    price = spark.createDataFrame([("a", DAY + dt.timedelta(days=i), float(i)) for i in (3, 10, 50)], "entity string, d date, close double")
    got = {r["i"]: r["close"] for r in J.asof_price(spine, price).collect()}
    new_year = (dt.date(2022, 1, 1) - DAY).days
    for i in range(60):
        seen = [p for p in (3, 10, 50) if p <= i and (p >= new_year) == (i >= new_year)]
        assert got[i] == (float(seen[-1]) if seen else None)
    filled = J.filled_price(J.asof_price(spine, price), ["close"])
    assert filled.where("close is null").count() == 0


def test_event_distance_and_reach_match_brute_force(spark):
    rnd = random.Random(8)
    days = [DAY + dt.timedelta(days=i) for i in range(0, 300, 2)]
    events = [(e, DAY + dt.timedelta(days=rnd.randrange(-30, 250))) for e in ("a", "b") for _ in range(25)]
    df = spark.createDataFrame([(e, d) for e in ("a", "b", "c") for d in days], "entity string, d date")
    ev = spark.createDataFrame(events, "entity string, d date")
    for r in J.with_event_reach(J.event_distance(df, ev), ev).collect():
        gaps = [(d - r["d"]).days for e, d in events if e == r["entity"]]
        assert r["days_to_next"] == min((g for g in gaps if g > 0), default=365)
        assert r["days_since_last"] == min((-g for g in gaps if g <= 0), default=365)
        near = [g for g in gaps if abs(g) <= 60]
        assert r["events_nearby"] == len(near)
        assert r["event_impact"] == pytest.approx(sum(math.exp(-abs(g) / 30) for g in near))


def test_event_study_windows(spark):
    values = [("a", DAY + dt.timedelta(days=i), float(i), 100.0 + i, 2.0) for i in range(-40, 40)]
    df = spark.createDataFrame(values, "entity string, d date, score double, close double, n_items double")
    ev = spark.createDataFrame([(1, "a", DAY, "x"), (2, "a", DAY, "y")], "event_id long, entity string, d date, category string")
    rows = event_study(ev, df).collect()
    assert len(rows) == 2
    r = rows[0]
    assert (r["pre_n"], r["post_n"], r["sample_size"]) == (28, 29, 57)
    assert r["score_change"] == pytest.approx(14 - -14.5)
    assert r["t_statistic"] < 0 and r["significant"]


@pytest.mark.parametrize(("t", "df", "p"), [(5.147569266656567, 37, 8.933232819736482e-06), (-0.8626653617603122, 55, 0.3920675504895389), (0.0, 5, 1.0)])
def test_t_tail(spark, t, df, p):
    got = spark.range(1).select(t_p_value(F.lit(t), F.lit(df))).first()[0]
    assert got == pytest.approx(p, rel=1e-6)


def test_t_tail_of_missing_values(spark):
    row = spark.range(1).select(t_p_value(F.lit(None).cast("double"), F.lit(3)), corr_p_value(F.lit(0.5), F.lit(2))).first()
    assert row[0] is None and row[1] is None
    one = spark.createDataFrame([(1.0, 2.0, None, 0.1, 1, 9)], "pre_mean double, post_mean double, pre_var double, post_var double, pre_n long, post_n long")
    assert pooled_t_test(one, p_value=False).first()["t_df"] == 8


@pytest.mark.parametrize("n", [1, 2, 7, 5_000, 250_000])
def test_exact_percentiles(spark, n):
    """All three bracket sizes, with a value that holds a third of the rows."""
    df = spark.range(n).selectExpr("'g' as g", "case when id % 3 = 0 then 7.0d else pmod(hash(id), 100003) / 1000.0d end as v")
    probs = {"a": 0.0, "b": 0.05, "c": 0.25, "d": 0.5, "e": 0.9, "f": 1.0}
    got = exact_percentiles(df, ["g"], ["v"], probs).first()
    values = np.array([r[0] for r in df.select("v").collect()])
    for name, p in probs.items():
        assert got[name] == pytest.approx(np.quantile(values, p), rel=1e-12), (name, p)


def test_histogram_edges(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(31)] + [("b", 2.0)], "entity string, v double")
    rows = A.histogram(df, "v", 30, ["entity"]).collect()
    a = sorted((r["bin"], r["n"]) for r in rows if r["entity"] == "a")
    assert len(a) == 30 and a[-1] == (29, 2) and sum(n for _, n in a) == 31
    assert sum(r["n"] for r in rows if r["entity"] == "b") == 1
    assert A.histogram(df, "v", 5).agg(F.sum("n")).first()[0] == 32


def test_daily_stats_single_item(spark):
    rows = [("a", DAY, 2.0, "positive"), ("b", DAY, 1.0, "positive"), ("b", DAY, 2.0, "neutral"), ("b", DAY, 3.0, None), ("b", None, 9.0, "neutral")]
    got = {r["entity"]: r for r in A.daily_stats(spark.createDataFrame(rows, "entity string, d date, score double, label string")).collect()}
    assert got["a"]["score_std"] == 0.0
    assert got["b"]["positive_ratio"] == pytest.approx(1 / 3) and got["b"]["n_items"] == 3


def test_signed_lag_and_ties(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=200)
    y = np.concatenate([np.zeros(3), x[:-3]])
    df = spark.createDataFrame(
        [("a", DAY + dt.timedelta(days=i), float(x[i]), float(y[i])) for i in range(200)], "entity string, d date, x double, y double"
    )
    assert best_lag(lag_correlation(df, "x", "y", max_lag=5)).first()["lag_days"] == 3
    tie = spark.createDataFrame([("a", 3, 0.6), ("a", -3, 0.6), ("a", 1, 0.1)], "entity string, lag_days int, correlation_price double")
    assert best_lag(tie).first()["lag_days"] == -3


def test_event_lanes_match_a_walk_over_the_events(spark):
    rnd = random.Random(3)
    events = sorted((DAY + dt.timedelta(days=rnd.randrange(400)), i) for i in range(60))
    events += [(events[10][0], 100 + i) for i in range(4)]
    want = {}
    for year in (2021, 2022):
        used, before = {}, None
        for d, i in sorted(e for e in events if e[0].year == year):
            lane = used.get(d, 0) + 1 if before and abs((d - before).days) < 15 else 0
            used[d], before, want[i] = lane, d, lane
    df = spark.createDataFrame([(i, "a", d) for d, i in events], "event_id long, entity string, d date").withColumn("year", F.year("d"))
    got = {r["event_id"]: r["lane"] for r in W.event_lanes(df, ["entity", "year"]).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and len(got) == len([e for e in events if e[0].year in (2021, 2022)])


def test_numbered_and_ends(spark):
    df = spark.createDataFrame([("b", DAY, 1.0), ("a", DAY, 2.0), ("c", DAY - dt.timedelta(days=1), 3.0)], "entity string, d date, v double")
    assert {r["entity"]: r["rn"] for r in numbered(df, "d", ["entity"]).collect()} == {"c": 1, "a": 2, "b": 3}
    ends = top_bottom(df, "v", "entity", 1)
    assert {(r["side"], r["entity"]) for r in ends.collect()} == {("top", "c"), ("bottom", "b")}


def test_correlation_matrix_uses_pairwise_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.1, 1.0), (3.0, 6.2, 0.0), (4.0, 7.9, 5.0)], "a double, b double, c double")
    pdf = df.toPandas().astype(float)
    for r in A.corr_matrix(df, ["a", "b", "c"]).collect():
        assert r["correlation"] == pytest.approx(pdf[r["left"]].corr(pdf[r["right"]]))


def test_numbering_a_hot_group_in_ranges(spark):
    df = spark.range(3000).selectExpr("pmod(hash(id), 1000000) * 10000L + id as k", "case when id % 3 = 0 then 'hot' else concat('g', id % 50) end as g")
    got = numbered_in_groups(df, ["g"], "k", slice_rows=100)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    assert got.select("k", "rn").exceptAll(want.select("k", F.col("rn").cast("long"))).count() == 0 and got.count() == 3000
