"""Reports from one read of the items, and ranks found in rounds."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from newstide.operators import aggregates as A
from newstide.operators import quantiles
from newstide.plans.report import analysis_report

DAY = dt.date(2021, 1, 1)


def items(spark, n=600, level=0.0):
    dice = random.Random(9)
    rows = []
    for k in range(n):
        e = "hot" if k % 3 else dice.choice(["a", "b", None])
        score = level + dice.gauss(0, 1) if dice.random() > 0.1 else None
        rows.append((e, DAY + dt.timedelta(days=dice.randrange(500)) if k % 50 else None, score, dice.choice(["positive", "negative", "neutral", None])))
    return rows, spark.createDataFrame(rows, "entity string, d date, score double, label string")


@pytest.mark.parametrize("level", [0.0, 1e7])
def test_merged_moments(spark, level):
    rows, df = items(spark, level=level)
    got = {r.entity: r for r in A.merged(A.fold_items(df), "entity").collect()}
    assert set(got) == {r[0] for r in rows}
    for e, r in got.items():
        part = [x for x in rows if x[0] == e]
        scores = [x[2] for x in part if x[2] is not None]
        assert r.n == len(part) and r.mean_score == pytest.approx(statistics.fmean(scores), rel=1e-12)
        assert r.std_score == pytest.approx(statistics.stdev(scores), rel=1e-8)
        assert (r.min_score, r.max_score) == (min(scores), max(scores))
        assert r.positive_ratio == pytest.approx(sum(x[3] == "positive" for x in part) / len(part))
        assert r.first_day == min(x[1] for x in part if x[1])
    ((whole),) = A.overview(df).collect()
    scores = [x[2] for x in rows if x[2] is not None]
    assert whole.n == len(rows) and whole.std_score == pytest.approx(statistics.stdev(scores), rel=1e-8)


@pytest.mark.parametrize(
    "report",
    [
        A.overview,
        A.label_distribution,
        A.entity_comparison,
        lambda df: A.describe_by(df, "entity", ["score"]),
        lambda df: analysis_report(df, df.sparkSession.createDataFrame([], "entity string, d date, actual double, predicted double")),
    ],
)
def test_reports_read_the_items_once(spark, report):
    _, df = items(spark)
    reads = {c: spark.sparkContext.accumulator(0) for c in ("label", "entity")}

    def counting(read):
        def seen(x):
            read.add(1)
            return x

        return F.udf(seen, "string").asNondeterministic()

    assert report(df.withColumns({c: counting(read)(c) for c, read in reads.items()})).collect()
    assert max(read.value for read in reads.values()) == df.count()


@pytest.mark.parametrize("leaf", [5, 40, 50_000])
def test_ranks_in_rounds(spark, monkeypatch, leaf):
    monkeypatch.setattr(quantiles, "LEAF", leaf)
    dice = np.random.default_rng(2)
    values = {
        "hot": [*dice.normal(size=900), *[0.0] * 700, *[3.5] * 300],
        "wide": [*(10.0 ** dice.uniform(-300, 300, 400)), *-(10.0 ** dice.uniform(-300, 300, 400))],
        "same": [2.0] * 500,
        "one": [7.0],
        "two": [1.0, 2.0],
        "whole": [float(x) for x in dice.integers(-3, 3, 500)],
    }
    probs = {"p0": 0.0, "p1": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99, "p100": 1.0}
    rows = [(g, float(v), -float(v) if k % 2 else None) for g, vs in values.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(4)
    got = {(r.g, r.column): r for r in quantiles.exact_percentiles(df, ["g"], ["v", "w"], probs).collect()}
    for g in values:
        for c, k in (("v", 1), ("w", 2)):
            data = [r[k] for r in rows if r[0] == g and r[k] is not None]
            if not data:
                assert (g, c) not in got
                continue
            for name, p in probs.items():
                data.sort()
                lo, hi = data[int(np.floor(p * (len(data) - 1)))], data[int(np.ceil(p * (len(data) - 1)))]
                want = lo + (hi - lo) * (p * (len(data) - 1) - np.floor(p * (len(data) - 1)))
                assert got[g, c][name] == want, (g, c, name)
    everything = quantiles.exact_percentiles(df, [], ["v"], {"p50": 0.5}).first()
    assert everything.p50 == np.percentile([r[1] for r in rows], 50)


def test_histogram_of_a_hot_group(spark):
    _, df = items(spark)
    got = A.histogram(df, "score", 7, ["entity"]).groupBy("entity").agg(F.sum("n").alias("n")).collect()
    assert {r.entity: r.n for r in got} == {r.entity: r.n for r in df.where("score is not null and entity is not null").groupBy("entity").agg(F.count("*").alias("n")).collect()}
    assert A.histogram(df, "score", 7).agg(F.sum("n")).first()[0] == df.where("score is not null").count()
