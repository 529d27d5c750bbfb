"""Sequences, splits, scaling, forecasts and measures."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from newstide.operators import evaluate as E
from newstide.operators import forecast as P
from newstide.operators import scaling as C
from newstide.operators import sequences as Q
from newstide.operators.rules import warning_level

DAY = dt.date(2021, 1, 1)


def daily(spark, lengths, fn=lambda e, i: float(i)):
    rows = [(e, DAY + dt.timedelta(days=i), fn(e, i), float(i % 3)) for e, n in lengths.items() for i in range(n)]
    return spark.createDataFrame(rows, "entity string, d date, v double, w double")


def test_sequence_counts_and_split(spark):
    seq = Q.sequences(daily(spark, {"a": 35, "b": 30, "c": 3}), ["v", "w"], "v", 30)
    assert seq.groupBy("entity").count().collect() == [("a", 5)]
    first = seq.orderBy("d").first()
    assert first["y"] == 30.0 and [x[0] for x in first["x"]] == [float(i) for i in range(30)]
    split = Q.temporal_split(seq).groupBy("split").count()
    assert {r["split"]: r["count"] for r in split.collect()} == {"train": 4, "test": 1}


def test_global_split_cuts_the_whole_table(spark):
    cut = Q.temporal_split(daily(spark, {"a": 50, "b": 50}), (("train", 0.6), ("validation", 0.2), ("test", 0.2)), by=(), tie=["entity"])
    counts = {r["split"]: (r["count"], r["lo"]) for r in cut.groupBy("split").agg(F.count("*").alias("count"), F.min("d").alias("lo")).collect()}
    assert [counts[s][0] for s in ("train", "validation", "test")] == [60, 20, 20]
    assert counts["test"][1] == DAY + dt.timedelta(days=40)


def test_scaling_constant_column(spark):
    df = daily(spark, {"a": 5}, lambda e, i: 4.0)
    bounds = C.minmax_bounds(df, ["v"], ["entity"])
    assert {r["v"] for r in C.minmax(df, bounds, ["v"], ["entity"]).collect()} == {0.0}
    assert {r["v"] for r in C.robust_scale(df, ["v"], ["entity"]).collect()} == {0.0}


def test_linear_fit_recovers_weights_and_forecasts(spark):
    rnd = np.random.default_rng(4)
    x = [1.0, 2.0]
    for _ in range(200):
        x.append(0.3 + 0.5 * x[-1] - 0.2 * x[-2] + 0.1 * rnd.normal())
    df = daily(spark, {"a": 200}, lambda e, i: float(x[i])).drop("w")
    seq = Q.sequences(df, ["v"], "v", 2)
    model = P.fit_linear(seq)
    weights = np.array(model.first()["weights"])
    design = np.column_stack([np.ones(198), x[:198], x[1:199]])
    want, *_ = np.linalg.lstsq(design, np.array(x[2:200]), rcond=None)
    np.testing.assert_allclose(weights, want, rtol=1e-4)
    path = P.forecast_linear(P.last_window(df, ["v"], 2), model, 3).orderBy("step").collect()
    tail = list(x[198:200])
    for r in path:
        tail.append(weights[0] + weights[1] * tail[-2] + weights[2] * tail[-1])
        assert r["predicted"] == pytest.approx(tail[-1])
    assert path[0]["d"] == DAY + dt.timedelta(days=200)


def test_recursive_forecast_keeps_the_other_features(spark):
    """Feature 0 of the newest row is replaced by the prediction, the rest is carried."""
    df = daily(spark, {"a": 4})
    model = spark.createDataFrame([("a", [0.0, 0.0, 0.0, 1.0, 10.0])], "entity string, weights array<double>")
    path = [r["predicted"] for r in P.forecast_linear(P.last_window(df, ["v", "w"], 2), model, 3).orderBy("step").collect()]
    assert path == [3.0, 3.0, 3.0]  # newest row (3.0, 0.0): 3 + 10 * 0, again and again


def test_measures(spark):
    rows = [("a", DAY + dt.timedelta(days=i), a, p) for i, (a, p) in enumerate([(1.0, 1.05), (2.0, 2.5), (1.5, 1.4), (3.0, 1.3)])]
    pred = spark.createDataFrame(rows, "entity string, d date, actual double, predicted double")
    m = E.regression_metrics(pred).first()
    a, p = np.array([1, 2, 1.5, 3.0]), np.array([1.05, 2.5, 1.4, 1.3])
    assert m["rmse"] == pytest.approx(np.sqrt(np.mean((p - a) ** 2)))
    assert m["r2"] == pytest.approx(1 - ((p - a) ** 2).sum() / ((a - a.mean()) ** 2).sum())
    assert m["mape"] == pytest.approx(np.mean(np.abs((p - a) / a)))
    d = E.direction_accuracy(pred).first()
    assert (d["direction_pct"], d["steps"]) == (pytest.approx(200 / 3), 3)
    assert E.threshold_accuracy(pred, ["entity"], 0.1001).first()["within_pct"] == 50.0


def test_best_epoch(spark):
    losses = [0.5, 0.3, 0.2, 0.4, 0.2, 0.9]
    h = spark.createDataFrame([("a", i + 1, x) for i, x in enumerate(losses)], "entity string, epoch int, val_loss double")
    r = E.best_epoch(h, patience=2).first()
    assert (r["best_epoch"], r["epochs_since_best"], r["stop_epoch"]) == (3, 3, 5)


@pytest.mark.parametrize(("price", "drop", "level"), [(-0.03, 0.1, 1), (0.0, 0.4, 2), (-0.03, 0.4, 3), (None, None, 0)])
def test_warning_levels(spark, price, drop, level):
    row = spark.createDataFrame([(price, drop)], "p double, s double").select(warning_level(F.col("p"), F.col("s"))).first()
    assert row[0] == level
