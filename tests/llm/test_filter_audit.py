"""The audit against filters applied one after the other in plain Python."""

import os
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from newstide.llm import filter_audit

SF = "/root/testdata/sf0.001"
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain(docs, labels):
    """docs: (id, text, source); labels: (id, quality, toxic). Rows by (part, order, step)."""
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = defaultdict(list)
    for i, t, source in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t],
        }
        parts[source or ""].append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        share = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                share[f] += len(gone)
                failing = sum(f in r[0] for r in rows)
                out[part, "".join(order), k + 1] = [len(left), len(gone), failing - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(share[order[step - 1]])
    return out


def check(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    found = filter_audit.audit(filter_audit.entries(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), "ABCDE", ["good", "toxic"])
    assert found.columns == ["part", "filter_order", "step", *COLUMNS]
    got = {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in found.collect()}
    assert got == plain(docs, labels)


def text(dice):
    words = [dice.choice(["aa", "bb", "Cc", "DDD", "é"]) if dice.random() < 0.4 else f"w{dice.randrange(500)}" for _ in range(dice.choice([0, 20, 49, 50, 51, 80]))]
    return " ".join(words) + dice.choice(["", " $", "|", "\n#"] + [""] * 4)


def test_random_rows(spark):
    dice = random.Random(5)
    stock = [text(dice) for _ in range(40)] + [None, "", "  "]
    docs = [(k, dice.choice(stock) if dice.random() < 0.5 else text(dice), dice.choice(["hot", "hot", "a", "b", "", None])) for k in range(800)]
    labels = [(dice.randrange(900), dice.choice([0, 1, None]), dice.choice([0, 1, None])) for _ in range(500)] + [(None, 1, 1)]
    check(spark, docs, labels)


def test_repeated_rows_and_ids_and_no_ids(spark):
    dice = random.Random(6)
    t = [text(dice) for _ in range(6)]
    docs = [(1, t[0], "a"), (1, t[0], "a"), (1, t[0], "b"), (1, t[1], "a"), (2, t[0], "a"), (None, t[0], "a"), (None, t[0], "a"), (None, t[2], None), (3, t[2], ""), (-4, t[1], "a")] * 3
    check(spark, docs + [(None, t[5], "hot")] * 400 + [(7, t[4], "hot")] * 400, [(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1)])


def test_one_group_of_copies_and_nothing(spark):
    check(spark, [(k, "the same text", f"s{k % 3}") for k in range(500)], [])
    check(spark, [], [(1, 1, 1)])


def test_other_filters_and_clashing_names(spark):
    df = spark.createDataFrame([("p", k, k % 4, 1, k % 2 == 0, "x") for k in range(40)], "part string, id int, fails int, weight int, odd boolean, filter string").withColumn("tie", F.col("id"))
    got = {(r.filter_order, r.step): r for r in filter_audit.audit(df, "xy", ["odd"]).collect()}
    assert set(got) == {("xy", 1), ("xy", 2), ("yx", 1), ("yx", 2)}
    assert tuple(got["yx", 2])[3:] == (10, 10, 10, 10, 0, 30)
    with pytest.raises(ValueError):
        filter_audit.audit(df, "abcdefgh")
    docs = spark.createDataFrame([(1, "a b", "s", 1, 2, 3, 4)], "doc_id long, text string, source string, tie int, part int, words int, good int")
    assert filter_audit.audit(filter_audit.entries(docs, docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))), "ABCDE", ["good", "toxic"]).count() == 600


def test_lists():
    dice = np.random.default_rng(7)
    for n, m in ((0, 5), (5, 0), (3, 500), (500, 3), (200, 300)):
        a, b = (np.unique(dice.integers(0, 600, k)) for k in (n, m))
        assert filter_audit.minus(a, b).tolist() == sorted(set(a.tolist()) - set(b.tolist()))
        lists = [a, b, a[::2], np.union1d(a, b)[::3]]
        for s, u in enumerate(filter_audit.unions(lists)):
            assert u.tolist() == sorted(set().union(*[set(x.tolist()) for f, x in enumerate(lists) if s >> f & 1]))


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not here")
def test_query(spark):
    from newstide.llm import catalog

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "labels"))
    want = plain([(r.doc_id, r.text, r.source) for r in docs], [(r.doc_id, r.quality, r.toxic) for r in labels])
    assert {tuple(r)[:3]: list(r)[3:] for r in catalog.op13_filter_audit(spark, SF).collect()} == want
