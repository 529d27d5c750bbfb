"""The registered queries: names, schemas, and a few of them against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not here")


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


@needs_data
def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5


@needs_data
@pytest.mark.parametrize(
    "name",
    ["daily_series", "prepared_news", "news_funnel", "asof_price", "event_study", "describe_by_entity", "lag_correlation", "forecast_with_band"],
)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    rel = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(rel.columns)
    order = sorted(got.columns)
    right = sorted(str(tuple(row[rel.columns.index(c)] for c in order)) for row in rel.fetchall())
    assert sorted(str(tuple(row[c] for c in order)) for row in got.collect()) == right
