"""Shards: sizes, slots, and how few links are cut."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newstide.llm import sharding

SCHEMA = "doc_id long, text string, shard string"


def check(rows, got, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    count = Counter(r.shard for r in got)
    sizes = [count[k] for k in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("copies", [(2,) * 60, (5, 9, 40, 3, 3, 3, 70), (500,), ()])
def test_groups_stay_together(spark, copies):
    rows = [(k, f"own text {k}", "x") for k in range(1200 - sum(copies))]
    for g, n in enumerate(copies):
        rows += [(len(rows) + k, f"copy of {g} é", "x") for k in range(n)]
    placed = sharding.assign(spark.createDataFrame(rows, SCHEMA).repartition(4), shards=6)
    got = placed.collect()
    check(rows, got, 6)
    links = sharding.cut_links(placed).first()
    assert links.links == sum(n - 1 for n in copies)
    floor = sum(max(0, n - 200) for n in copies)  # what does not fit into a shard
    assert links.cut <= floor + 0.15 * links.links


def test_edges(spark):
    assert sharding.assign(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, "a"), (None, "x", "b"), (1, "x", "c"), (1, "x", "c"), (2, "", "d"), (3, None, "e"), (4, "y" * 100_000, "f")]
    check(rows, sharding.assign(spark.createDataFrame(rows, SCHEMA)).collect(), 24)
    check(rows, sharding.assign(spark.createDataFrame(rows, SCHEMA), shards=1).collect(), 1)


def test_numbers_are_gapless(spark):
    df = spark.range(5000).selectExpr("id as key", "if(id % 3 = 0, 7, 1) as g")
    got = sharding._numbered(df, "g", [df["key"]], "n").collect()
    for g in (1, 7):
        assert sorted(r.n for r in got if r.g == g) == list(range(sum(r.g == g for r in got)))


@pytest.mark.parametrize(("copies", "shards"), [((800,), 24), ((700, 650, 300), 24), ((90, 90, 90, 60, 60), 24), ((800, *[4] * 60), 24), ((500, 400, 290), 6)])
def test_groups_span_few_shards(spark, copies, shards):
    rows = [(k, f"own text {k}", "x") for k in range(2400 - sum(copies))]
    for g, n in enumerate(copies):
        rows += [(len(rows) + k, f"copy of {g}", "x") for k in range(n)]
    got = sharding.assign(spark.createDataFrame(rows, SCHEMA).repartition(4), shards=shards).collect()
    check(rows, got, shards)
    held = {}
    for r in got:
        held.setdefault(r.text_crc32, Counter())[r.shard] += 1
    spans = [len(held[zlib.crc32(f"copy of {g}".encode())]) for g in range(len(copies))]
    fewest = [-(-n * shards // 2400) for n in copies]
    assert sum(spans) <= sum(fewest) + 0.1 * sum(n < 10 for n in copies)
    assert all(a <= b + 1 for a, b in zip(spans, fewest, strict=True))


def test_rounds_go_on_while_they_gain(spark):
    rows = [(k, f"pair {k // 2}" if k < 1160 else f"own text {k}", "x") for k in range(1200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    cut = [sharding.cut_links(sharding.assign(df, shards=6, gain=gain)).first().cut for gain in (0.4, 0.001)]
    assert cut[1] < 0.5 * cut[0] and cut[1] <= 0.1 * 580


def test_places_do_not_depend_on_the_layout(spark):
    rows = [(k, f"copy of {k % 7}" if k % 3 == 0 else f"own text {k}", "x") for k in range(900)] + [(None, "same", "x")] * 50 + [(5, None, "x")] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    layouts = [df.repartition(2), df.repartition(7, "text").sortWithinPartitions(F.desc("doc_id"))]
    one, other = ([tuple(r) for r in sharding.assign(d, shards=6).collect()] for d in layouts)
    assert Counter(one) == Counter(other)
    check(rows, sharding.assign(layouts[1], shards=6).collect(), 6)


def test_rounds_are_bounded(spark):
    rows = [(k, f"pair {k // 2}", "x") for k in range(120)]
    check(rows, sharding.assign(spark.createDataFrame(rows, SCHEMA), shards=6, rounds=0).collect(), 6)
