"""Trees as expressions, rolling forecasts and block sums against plain loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from newstide.operators import forecast as P
from newstide.operators import sequences as Q
from newstide.operators import trees as T
from newstide.operators.blocks import block_sums, correlations

DAY = dt.date(2021, 1, 1)
PARTS = (("train", 0.6), ("validation", 0.2), ("test", 0.2))


def waves(spark, n=160):
    dice = np.random.default_rng(3)
    rows = []
    for e in ("a", "b"):
        y = 2.0
        for k in range(n):
            y = 0.6 * y + np.sin(k / 5) + 0.3 * dice.normal() + (e == "b")
            rows.append((e, DAY + dt.timedelta(days=k), float(y), float(k % 7)))
    return spark.createDataFrame(rows, "entity string, d date, v double, w double")


@pytest.fixture(scope="module")
def fitted(spark):
    df = waves(spark)
    seq = Q.temporal_split(Q.sequences(df, ["v", "w"], "v", 3), PARTS).cache()
    model = P.fit_trees(seq.where("split = 'train'"), maxIter=8, maxDepth=3, stepSize=0.4)
    return df, seq, model, T.forest(spark, model)


def test_forest_scores_as_the_model(fitted):
    _, seq, model, trees = fitted
    want = {(r.entity, r.d): r.predicted for r in P.tree_predictions(seq, model).collect()}
    rows = T.score_rows(seq, trees).collect()
    assert len(rows) == len(want) and all(r.predicted == pytest.approx(want[r.entity, r.d], abs=1e-12) for r in rows)


def test_losses_by_round_and_the_best_one(fitted):
    _, seq, _, trees = fitted
    rows = [(r.split, [v for x in r.x for v in x], r.y) for r in seq.collect()]
    got = {(r.split, r.round): (r.n, r.loss) for r in T.round_losses(seq, trees).collect()}
    want = {}
    for split in ("train", "validation", "test"):
        part = [(x, y) for s, x, y in rows if s == split]
        for k in range(1, 9):
            cut = trees.first(k)
            want[split, k] = len(part), np.mean([(cut.plain(x) - y) ** 2 for x, y in part])
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    best = min(range(1, 9), key=lambda k: (want["validation", k][1], k))
    kept, _ = T.fit_best_trees(seq, maxIter=8, maxDepth=3, stepSize=0.4)
    assert len(kept.roots) == best == T.best_rounds(T.round_losses(seq, trees))
    assert T.best_rounds(T.round_losses(seq.where("split = 'train'"), trees)) is None


def test_forecast_equals_a_plain_loop(fitted):
    df, _, _, trees = fitted
    window = P.last_window(df, ["v", "w"], 3)
    got = {(r.entity, r.step): (r.d, r.predicted) for r in T.forecast_trees(window, trees, 12).collect()}
    for r in window.collect():
        x = [list(row) for row in r.x]
        for step in range(1, 13):
            y = trees.plain([v for row in x for v in row])
            assert got[r.entity, step] == (r.d + dt.timedelta(days=step), pytest.approx(y, abs=1e-12))
            x = [*x[1:], [y, *x[-1][1:]]]


def test_rolling_forecast_uses_the_past_only(spark):
    df = waves(spark, 60)
    got = {(r.entity, r.d): r for r in P.rolling_ar1(df, "v", 3, 10).collect()}
    for e in ("a", "b"):
        y = [r.v for r in df.where(F.col("entity") == e).orderBy("d").collect()]
        for k in range(60):
            r = got[e, DAY + dt.timedelta(days=k)]
            assert r.n_pairs == k
            if k < 10:
                assert r.predicted is None
                continue
            b, a = np.polyfit(y[:k], y[1 : k + 1], 1)
            want = y[k]
            for _ in range(3):
                want = a + b * want
            assert r.predicted == pytest.approx(want, rel=1e-9)


def test_block_sums_and_correlations(spark):
    dice = np.random.default_rng(5)
    data = dice.normal(size=(700, 6)) + [0, 1e6, 0, -40, 0, 0]
    data[:, 2] = data[:, 0] * 2 + dice.normal(size=700) * 0.1
    data[:, 4] = 7.5
    there = dice.random((700, 6)) > 0.2
    rows = [(f"g{k % 3}", *[float(v) if t else None for v, t in zip(x, m, strict=True)]) for k, (x, m) in enumerate(zip(data, there, strict=True))]
    cols = [f"c.{k}" for k in range(6)]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"`{c}` double" for c in cols)).repartition(5)
    for r in block_sums(df, F.array(*[F.col(f"`{c}`") for c in cols]), ["g"]).collect():
        both = [(x[1 + r.i], x[1 + r.j]) for x in rows if x[0] == r.g and x[1 + r.i] is not None and x[1 + r.j] is not None]
        a, b = np.array(both).T
        assert r.n == len(both)
        np.testing.assert_allclose([r.si, r.sj, r.sii, r.sjj, r.sij], [a.sum(), b.sum(), (a * a).sum(), (b * b).sum(), (a * b).sum()], rtol=1e-9, atol=1e-6)
    found = {(r.left, r.right): r for r in correlations(df, cols).collect()}
    assert len(found) == 15
    for (left, right), r in found.items():
        i, j = cols.index(left), cols.index(right)
        ok = there[:, i] & there[:, j]
        assert r.n == ok.sum()
        if 4 in (i, j):
            assert r.correlation is None
        else:
            assert r.correlation == pytest.approx(np.corrcoef(data[ok, i], data[ok, j])[0, 1], abs=1e-9)
    assert correlations(df.limit(0), cols).count() == 0


def test_many_groups(spark):
    df = spark.range(2000).select((F.col("id") % 50).alias("g"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    want = block_sums(df, F.col("v"), ["g"]).orderBy("g", "i", "j").collect()
    assert len(want) == 150 and sum(r.si for r in want if r.i == r.j == 0) == sum(range(2000))
