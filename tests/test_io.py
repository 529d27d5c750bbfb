"""Readers and writers on files of their own."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from newstide.functions.words import NEWS_FRAGMENTS, NEWS_HEADERS
from newstide.sources import sinks, tables


def test_charsets_and_bom(spark, tmp_path):
    (tmp_path / "kr.csv").write_bytes("일자,제목\n2021-01-05,삼성\n".encode("cp949"))
    (tmp_path / "bom.csv").write_bytes("﻿일자,제목\n2021-01-05,애플\n".encode())
    assert tables.read_csv(spark, str(tmp_path / "kr.csv"), encoding="MS949").first()["제목"] == "삼성"
    assert tables.read_csv(spark, str(tmp_path / "bom.csv")).columns == ["일자", "제목"]


def test_headers_by_alias_and_by_fragment(spark):
    df = spark.createDataFrame([("1", "20210105", "t")], ["ID", "날짜", "title"])
    assert tables.resolve_columns(df, NEWS_HEADERS).columns == ["news_id", "date", "title"]
    assert tables.match_headers(["일자", "제목", "본문내용", "Media name", "update"], NEWS_FRAGMENTS) == {
        "date": "update",
        "title": "제목",
        "body": "본문내용",
        "publisher": "Media name",
    }
    assert tables.resolve_fuzzy(df.drop("title"), NEWS_FRAGMENTS) is None
    assert tables.strip_headers(df.withColumnRenamed("ID", " ID ")).columns[0] == "ID"


def test_unusable_files_are_skipped(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,title,keyword\n2021-01-05,x,k\n")
    (tmp_path / "b.csv").write_text("title,other\nx,y\n")
    (tmp_path / "c.csv").write_text("날짜,제목\n20210106,z\n")
    paths = [str(tmp_path / f) for f in ("a.csv", "b.csv", "missing.csv", "c.csv")]
    got = {(r["file_idx"], r["title"], r["keywords"]) for r in tables.read_each(spark, paths, NEWS_FRAGMENTS).collect()}
    assert got == {(0, "x", "k"), (3, "z", None)}


@pytest.mark.parametrize(("raw", "want"), [("64.06M", 64_060_000), ("12624702", 12_624_702), ("1,234", 1234), ("1.5k", 1500), ("-", None), (None, None)])
def test_volumes(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "v string").select(tables.parse_volume(F.col("v"))).first()[0] == want


def test_prices_of_both_styles_and_reversed_years(spark, tmp_path):
    (tmp_path / "x_stock_2021.csv").write_text("Date,Close,Open,High,Low,Vol.\n12/31/2021,177.57,178,179,177,64.06M\n")
    (tmp_path / "y_stock_2021.csv").write_text("Date,Close,Open,High,Low,Vol.\n2024-12-30,53200,53300,54000,53100,12624702\n")
    raw = tables.with_file(tables.read_csv(spark, f"{tmp_path}/*.csv", tables.PRICE_TEXT))
    got = {r["file"]: r for r in tables.file_profile(tables.parse_prices(raw)).collect()}
    assert got["x_stock_2021.csv"]["first_day"] == dt.date(2021, 12, 31) and not got["x_stock_2021.csv"]["year_mismatch"]
    assert got["y_stock_2021.csv"]["year_mismatch"]
    assert raw.select(tables.file_part(F.col("file"), 1)).distinct().count() == 2


def test_launches(spark, tmp_path):
    (tmp_path / "l.csv").write_text('Date,Product,Company,Category,Type\n2021-01-05,"Book 14""",Acme,Unknown,x\nsoon,Pad,Acme,Unknown,x\n')
    rows = tables.parse_launches(tables.read_csv(spark, str(tmp_path / "l.csv"), tables.LAUNCHES)).collect()
    assert [(r["d"], r["product"], r["entity"]) for r in rows] == [(dt.date(2021, 1, 5), 'Book 14"', "acme")]


def test_scored_news_is_written_by_entity_and_year(spark, tmp_path):
    from newstide.plans.news import score_news

    raw = spark.createDataFrame(
        [("20210105", "애플 신제품", None), ("2022-03-01", "삼성 실적", "반도체"), ("20220301", "날씨", "비")], ["date", "title", "keywords"]
    )
    load = lambda: lambda batch: [{"positive": 0.75, "negative": 0.25} for _ in batch]
    scored = score_news(raw, load).withColumn("year", F.year("date"))
    sinks.write_by_key(scored, str(tmp_path / "s"), ["entity", "year"], ["date"])
    back = tables.read_csv(spark, str(tmp_path / "s"))
    assert {(r["entity"], r["year"], r["label"], r["score"]) for r in back.collect()} == {
        ("apple", 2021, "positive", "4.0"),
        ("samsung", 2022, "positive", "4.0"),
    }


def test_sinks(spark, tmp_path):
    df = spark.range(20).selectExpr("id", "concat('e', id % 2) as entity", "'say \"hi\", you' as t")
    sinks.write_by_key(df, str(tmp_path / "o"), ["entity"], ["id"])
    back = tables.read_csv(spark, str(tmp_path / "o"))
    assert back.count() == 20 and back.first()["t"] == 'say "hi", you'
    assert json.loads(sinks.as_json(df.limit(1)).first()[0])["entity"] == "e0"


def test_a_hot_key_is_cut_in_ranges(spark, tmp_path):
    df = spark.range(4000).selectExpr("id", "case when id % 2 = 0 then 'hot' when id % 101 = 1 then null else concat('k', id % 7) end as entity", "repeat('x', 50) as t")
    out = tmp_path / "o"
    sinks.write_by_key(df.repartition(5), str(out), ["entity"], ["id"], file_bytes=12_000)
    files = {d.name: sorted(d.glob("*.csv")) for d in out.iterdir() if d.is_dir()}
    assert len(files["entity=hot"]) >= 8 and all(len(f) == 1 or k == "entity=hot" or "k" in k for k, f in files.items())
    ranges = []
    for f in files["entity=hot"]:
        ids = [int(line.split(",")[0]) for line in f.read_text().splitlines()[1:]]
        assert ids == sorted(ids) and len(ids) < 600
        ranges.append((ids[0], ids[-1]))
    ranges.sort()
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert tables.read_csv(spark, str(out)).count() == 4000


def test_many_files_are_a_scan_for_each_header(spark, tmp_path):
    paths = []
    for k in range(300):
        header = ("date,title,keyword", "날짜,제목", "title,other")[k % 3]
        path = tmp_path / (f"f {k},.csv" if k else "f [0,.csv")
        path.write_text(f"{header}\n" + ("20210105,t%d,k\n" % k if k % 3 == 0 else "2021-01-05,t%d\n" % k))
        paths.append(str(path))
    paths.insert(7, str(tmp_path / "missing.csv"))
    paths.insert(9, str(tmp_path / "nowhere" / "x.csv"))
    df = tables.read_each(spark, paths, NEWS_FRAGMENTS)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2
    got = {r.title: (r.file_idx, r.keywords) for r in df.collect()}
    assert got == {f"t{k}": (next(i for i, p in enumerate(paths) if f"f {k}," in p or not k and "[0" in p), "k" if k % 3 == 0 else None) for k in range(300) if k % 3 < 2}
    with pytest.raises(ValueError):
        tables.read_each(spark, [str(tmp_path / "nowhere" / "x.csv")], NEWS_FRAGMENTS)


def test_what_is_lost_is_reported(spark, tmp_path):
    import gzip

    (tmp_path / "a.csv").write_text("d,v\n2021-01-05,1.5\n2021-01-06,oops\n2021-01-07,\n")
    (tmp_path / "b.csv").write_text("d,other\n2021-01-05,1\n")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv.gz").write_bytes(b"this is no gzip file" * 20)
    (tmp_path / "e.csv.gz").write_bytes(gzip.compress(b"d,v\n2021-01-08,2\n"))
    schema = "d date, v double"
    rows, report = tables.tolerant_load(spark, str(tmp_path), spark.createDataFrame([], schema).schema, ["v", "d"])
    got = {r.path.rsplit("/", 1)[1]: tuple(r)[1:] for r in report.collect()}
    assert got == {
        "a.csv": ("read", 3, 1, 2), "b.csv": ("no header", 0, 0, 0), "c.csv": ("nothing read", 0, 0, 0),
        "d.csv.gz": ("nothing read", 0, 0, 0), "e.csv.gz": ("read", 1, 0, 0),
    }
    assert sorted((str(r.d), r.v) for r in rows.collect() if r.broken is None) == [("2021-01-05", 1.5), ("2021-01-07", None), ("2021-01-08", 2.0)]


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert tables.require_columns(df, ["a"]) is df
    with pytest.raises(ValueError, match="c"):
        tables.require_columns(df, ["a", "c"])
