"""Streams in several batches give the result of the batch twin."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newstide.streaming import twins

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Ten files in time order, about half a day each, with a repeated key per day."""
    path = tmp_path_factory.mktemp("feed")
    rows = [(i, START + dt.timedelta(minutes=12 * i), f"e{i % 3}", float(i % 50) / 10, "positive" if i % 4 else "negative") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, entity string, score double, label string")
    for k in range(10):
        df.where(F.col("id").between(60 * k, 60 * k + 59)).coalesce(1).write.mode("append").parquet(str(path))
    return str(path), df


@pytest.mark.parametrize(("length", "slide"), [(1, None), (3, 1)])
def test_windows_equal_batch(spark, feed, length, slide):
    path, df = feed
    options = {"length": f"{length} days", "slide": f"{slide} day" if slide else None}
    pick = ["entity", F.col("w.start").alias("w_start"), "score_mean", "n_items", "positive_ratio"]
    build = lambda feed: twins.windowed_stats(feed, ["entity"], **options).select(*pick)
    got = twins.run_closed(spark, path, df.schema, build, "t-windows", files_per_batch=2)
    window = F.window("ts", options["length"], options["slide"]) if slide else F.window("ts", options["length"])
    want = (
        df.groupBy(window.alias("w"), "entity")
        .agg(F.avg("score").alias("score_mean"), F.count("*").alias("n_items"), F.avg((F.col("label") == "positive").cast("double")).alias("positive_ratio"))
        .select(*pick)
    )
    rounded = [F.round(c, 9) if c.endswith(("mean", "ratio")) else F.col(c) for c in got.columns]
    assert sorted(map(tuple, got.select(*rounded).collect())) == sorted(map(tuple, want.select(*rounded).collect()))


def test_unique_equals_batch(spark, feed):
    path, df = feed
    stream = twins.read_stream(spark, path, df.schema, files_per_batch=3).withColumn("d", F.to_date("ts"))
    got = twins.run_available(twins.unique_within(stream, ["entity", "d"]), "t-unique")
    assert got.count() == df.select("entity", F.to_date("ts")).distinct().count()


def test_alerts(spark, feed):
    path, df = feed
    stream = twins.read_stream(spark, path, df.schema, files_per_batch=4)
    got = twins.run_closed(spark, path, df.schema, lambda feed: twins.change_alerts(feed, ["entity"], 0.05), "t-change").collect()
    daily = {(r["entity"], r["d"]): r["m"] for r in df.groupBy("entity", F.to_date("ts").alias("d")).agg(F.avg("score").alias("m")).collect()}
    falls = {k for k, m in daily.items() if (before := daily.get((k[0], k[1] - dt.timedelta(days=1)))) is not None and m - before < -0.05}
    assert {(r["entity"], r["w_start"].date()) for r in got} == falls
    for r in got:
        day = r["w_start"].date()
        change = daily[r["entity"], day] - daily[r["entity"], day - dt.timedelta(days=1)]
        assert r["change"] == pytest.approx(change) and change < -0.05
    low = twins.threshold_alerts(twins.windowed_stats(stream, ["entity"]).select("entity", "score_mean"), 2.45)
    assert twins.run_available(low, "t-low").where("score_mean >= 2.45").count() == 0
