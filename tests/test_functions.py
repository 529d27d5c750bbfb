"""Text, date and score columns on literal cases."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from newstide.functions import dates, scores, text
from newstide.functions.scoring import score_texts, with_sentiment


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("<b>a</b>\n\tb  c ", "a b c"), (None, ""), ("a 　b", "a b"), ("<p\nx>y", "<p x>y"), ("", "")],
)
def test_clean_html(spark, raw, clean):
    assert one(spark, text.clean_html("v"), raw) == clean


@pytest.mark.parametrize(
    ("raw", "clean"), [("<p\nx>y", "y"), ("삼성전자 (주) 50%!", "삼성전자 주 50%!"), ("a#b_c é", "a b_c é"), (None, "")]
)
def test_clean_strict(spark, raw, clean):
    assert one(spark, text.clean_strict("v"), raw) == clean


def test_combined_text(spark):
    rows = [(" t ", "k", "b" * 600), ("", None, "b"), ("t", " ", None)]
    df = spark.createDataFrame(rows, "t string, k string, b string")
    got = [r[0] for r in df.select(text.combine_text("t", "k", "b")).collect()]
    assert got == ["t 키워드: k " + "b" * 500, "b", "t"]


def test_entity_rules(spark):
    first = text.entity_first_match("v", (("samsung", ("삼성",)), ("apple", ("애플",))))
    assert one(spark, first, "애플과 삼성") == "samsung"
    assert one(spark, first, "애플") == "apple"
    assert one(spark, first, "none") is None
    vote = text.entity_vote("v", {"a": ("x", "y"), "b": ("z", "w")})
    cases = {"X y z": "a", "x z": "both", "q": "none", "z w x": "b", None: "none", "xxx": "a"}
    for raw, want in cases.items():
        assert one(spark, vote, raw) == want


def test_entity_vote_three_way(spark):
    vote = text.entity_vote("v", {"a": ("x",), "b": ("y",), "c": ("z", "w")})
    assert one(spark, vote, "x y z w") == "c"
    assert one(spark, vote, "x y z") == "both"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("20210105", "2021-01-05"),
        ("2021-01-05 09:00", "2021-01-05"),
        ("2021/01/05", "2021/01/05"),
        ("2021/1/5", "2021-/1-/5"),
        (None, None),
    ],
)
def test_standard_date(spark, raw, want):
    assert one(spark, dates.standardize_date(F.col("v")), raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("20210105", dt.date(2021, 1, 5)),
        ("2021-01-05", dt.date(2021, 1, 5)),
        ("01/05/2021", dt.date(2021, 1, 5)),
        ("2021-/1-/5", None),
        ("nonsense", None),
        (None, None),
    ],
)
def test_parse_date(spark, raw, want):
    assert one(spark, dates.parse_date(F.col("v")), raw) == want


def test_year_slice_is_a_range_predicate(spark):
    df = spark.createDataFrame([(dt.date(2020, 12, 31),), (dt.date(2021, 1, 1),), (dt.date(2021, 12, 31),)], "d date")
    assert dates.year_slice(df, "d", 2021).count() == 2


def probs(spark, p):
    return spark.createDataFrame([(p,)], "p map<string,double>")


def test_scores(spark):
    full = {"positive": 0.7, "neutral": 0.2, "negative": 0.1}
    p = F.col("p")
    row = probs(spark, full).select(scores.score_diff(p), scores.score_weighted(p), scores.argmax_label(p)).first()
    assert row[0] == pytest.approx(4.2) and row[1] == pytest.approx(4.2) and row[2] == "positive"
    assert probs(spark, {}).select(scores.score_diff(p)).first()[0] == 3.0
    tie = probs(spark, {"neutral": 0.5, "positive": 0.5}).select(scores.argmax_label(p)).first()[0]
    assert tie == "neutral"
    single = scores.score_single(F.lit("negative"), F.lit(0.9))
    assert one(spark, single) == pytest.approx(1.2)
    assert one(spark, scores.finite(F.lit(float("inf")))) is None
    assert one(spark, scores.grade(F.lit(0.7))) == "good"
    assert [one(spark, scores.outlook(F.lit(x))) for x in (0.2, -0.2, 0.1)] == ["improve", "worsen", "stable"]


def test_failed_batches_turn_neutral(spark):
    def load():
        def score(batch):
            if "bad" in batch:
                raise RuntimeError("model failed")
            return [{"positive": 1.0} for _ in batch]

        return score

    df = spark.createDataFrame([("good",), ("bad",), (None,)], "t string").coalesce(1)
    got = with_sentiment(score_texts(df, "t", load, batch=1)).select("score", "label").collect()
    assert [tuple(r) for r in got] == [(5.0, "positive"), (3.0, "neutral"), (5.0, "positive")]


def test_calendar(spark):
    row = (
        spark.createDataFrame([(dt.date(2024, 12, 30),)], "d date").transform(lambda df: dates.calendar_features(df, "d")).first()
    )
    assert (row["quarter"], row["week_of_year"], row["is_quarter_end"], row["is_year_end"], row["is_season"]) == (4, 1, 1, 1, 0)
    assert row["month_cos"] == pytest.approx(math.cos(2 * math.pi))
