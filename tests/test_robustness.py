"""Cases at the edges: no shared folder, resumed streams, mixed categories, hot keys, failing scorers, events without days."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from newstide import session
from newstide.functions.dates import parse_date
from newstide.functions.scoring import score_texts
from newstide.operators import aggregates as A
from newstide.operators.impact import event_study, smoothed
from newstide.operators.skew import grid_cuts
from newstide.plans.news import NewsPrep, funnel
from newstide.sources import tables
from newstide.streaming.twins import read_stream, run_available


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Session:
        sparkContext = Context  # noqa: N815

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session)


def test_a_stream_resumes_where_it_stopped(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(3)
    rows.write.parquet(source)
    assert run_available(read_stream(spark, source, rows.schema), "s", base).count() == 3
    spark.range(3, 5).write.mode("append").parquet(source)
    got = run_available(read_stream(spark, source, rows.schema), "s", base)
    assert sorted(r.id for r in got.collect()) == [0, 1, 2, 3, 4]


def test_null_and_unknown_categories_count_together(spark):
    rows = [(None, 1.0, 2.0, True), ("Unknown", 3.0, None, False), ("phone", None, 4.0, False)]
    study = spark.createDataFrame(rows, "category string, score_change double, price_change_pct double, significant boolean")
    got = A.impact_summary(study).first()
    assert got.category_breakdown == {"Unknown": 2, "phone": 1} and (got.n_events, got.score_change_mean, got.price_change_mean) == (3, 2.0, 3.0)


def test_fragments_are_plain_text(spark):
    features = spark.createDataFrame([("a.b",), ("axb",), ("c+d",)], "feature string")
    got = {r.feature_group: r.members for r in A.feature_groups(features, {"dot": ["a.b"], "plus": ["+"]}).collect()}
    assert got == {"dot": "a.b", "plus": "c+d"}


@pytest.mark.parametrize("text", ["2021-01-05 09:00", "2021-01-05T09:00:00", "2021-01-05 09:00:00.0", "2021.01.05", "2021-1-5", "20210105", "01/05/2021", "2021-01-05T09:00:00Z"])
def test_dates_with_times(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(parse_date(F.col("t"))).first()[0] == dt.date(2021, 1, 5)


@pytest.mark.parametrize("text", ["2021", "2021-13-05", "yesterday", "", None, "2021-02-30"])
def test_no_dates(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(parse_date(F.col("t"))).first()[0] is None


def test_every_key_above_a_cell_is_cut(spark):
    hot = spark.range(500).select((F.col("id") % 5).alias("k"))
    cuts = {r.k: (r._cut_v, r._cut_o) for r in grid_cuts(hot, spark.range(5).withColumnRenamed("id", "k"), ["k"], cell=30).collect()}
    assert cuts == {k: (4, 1) for k in range(5)}


def test_a_scorer_of_the_wrong_length_says_so(spark):
    df = spark.createDataFrame([("a" * 600,), ("b",)], "t string").coalesce(1)
    got = score_texts(df, "t", lambda: lambda chunk: [{"positive": float(len(t))} for t in chunk][:1], batch=2).collect()
    assert all(r.probs is None and "1 results for 2 texts" in r.score_error for r in got)
    got = score_texts(df, "t", lambda: lambda chunk: [{"positive": float(len(t))} for t in chunk], limit=512).collect()
    assert [r.probs["positive"] for r in got] == [512.0, 1.0] and all(r.score_error is None for r in got)


def test_broken_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\nx,3\n")
    schema = "a int, b int"
    from pyspark.sql.types import _parse_datatype_string

    got = tables.read_csv(spark, str(tmp_path / "x.csv"), _parse_datatype_string(schema), corrupt="broken").orderBy("b").collect()
    assert [(r.a, r.b, r.broken) for r in got] == [(1, 2, None), (None, 3, "x,3")]


def test_windows_hold_every_calendar_day_and_lonely_events_stay(spark):
    first = dt.date(2021, 3, 1)
    days = [("e", first + dt.timedelta(k), 3.0 + (k >= 60), 100.0 + k, 5.0) for k in range(120)]
    values = smoothed(spark.createDataFrame(days, "entity string, d date, score double, close double, n_items double"))
    events = spark.createDataFrame([(1, "e", first + dt.timedelta(60)), (2, "e", dt.date(1999, 1, 1)), (3, "none", first)], "event_id long, entity string, d date")
    got = {r.event_id: r for r in event_study(events, values).collect()}
    assert got[1].sample_size == 57 and got[1].significant and got[1].score_change > 0.9
    assert [(got[k].sample_size, got[k].significant, got[k].score_change) for k in (2, 3)] == [(0, False, None)] * 2


def test_funnel_shuffles_no_texts(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(k, f"title{k}", "20240101", "x" * 300, "nth") for k in range(9)], "doc_id long, title string, date string, body string, keywords string")
        steps = funnel(df, NewsPrep(relevant=("nth",)))
        plan = spark._jvm.PythonSQLUtils.explainString(steps._jdf.queryExecution(), "formatted")
        moved = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", plan)
        assert moved and not any("body#" in x for x in moved)
        assert [r.n for r in steps.orderBy("step").collect()] == [9, 9, 9, 9, 9]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
