"""Near-duplicate resolution against brute force over all pairs."""

import datetime as dt
import math
import random
import re
from collections import Counter

import pytest

from newstide.operators import similarity as S
from newstide.operators.dedupe import dedupe_first
from newstide.operators.similarity import Similarity, similar_survivors
from newstide.operators.skew import grid_cuts, hot_keys, sliced_join

SCHEMA = "id long, title string, d date, src string"


def brute(rows, threshold=0.8, by_source=False):
    lost = set()
    groups = {}
    for r in rows:
        groups.setdefault(r[3] if by_source else 0, []).append(r)
    for group in groups.values():
        bags = [Counter(re.findall(r"\w\w+", (r[1] or "").lower())) for r in group]
        df = Counter(t for b in bags for t in b)
        vectors = []
        for b in bags:
            v = {t: c * (math.log((1 + len(group)) / (1 + df[t])) + 1) for t, c in b.items()}
            norm = math.sqrt(sum(w * w for w in v.values())) or 1.0
            vectors.append({t: w / norm for t, w in v.items()})
        for i, a in enumerate(group):
            for j in range(i + 1, len(group)):
                b = group[j]
                if sum(w * vectors[j].get(t, 0.0) for t, w in vectors[i].items()) > threshold:
                    lost.add(b[0] if (a[2] or dt.date.min) >= (b[2] or dt.date.min) else a[0])
    return {r[0] for r in rows} - lost


def titles(n, seed, copies=0.35, vocabulary=60):
    """Random titles, a large group of near copies, word-order variants and wordless rows."""
    rnd = random.Random(seed)
    words = [f"w{i:02d}" for i in range(vocabulary)]
    rows = []
    for i in range(n):
        u = rnd.random()
        if u < copies:
            t = f"daily market report from the exchange floor number {rnd.randrange(40)}"
            if rnd.random() < 0.3:
                t = t.upper()
        elif u < copies + 0.05:
            t = rnd.choice(["!", "a b", "", None])
        else:
            base = random.Random(rnd.randrange(n // 4))
            picked = base.sample(words, 8)
            if rnd.random() < 0.5:
                picked[rnd.randrange(8)] = rnd.choice(words)
            rnd.shuffle(picked)
            t = " ".join(picked)
        day = None if rnd.random() < 0.05 else dt.date(2021, 1, 1) + dt.timedelta(days=rnd.randrange(30))
        rows.append((i, t, day, f"s{rnd.randrange(3)}"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_survivors_match_brute_force(spark, seed):
    rows = titles(300, seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = similar_survivors(df, "id", "title", "d")
    assert {r["id"] for r in got.collect()} == brute(rows)


def test_completion_alone_is_exact(spark, monkeypatch):
    """Without the pruning step and with tiny cells the prefix join still finds every loser."""
    monkeypatch.setattr(S, "_prune", lambda v, cfg: v.where("false").select("id"))
    monkeypatch.setattr(S, "grid_cuts", lambda a, b, k: grid_cuts(a, b, k, cell=5))
    rows = titles(200, 3)
    got = similar_survivors(spark.createDataFrame(rows, SCHEMA), "id", "title", "d")
    assert {r["id"] for r in got.collect()} == brute(rows)


def long_copies(n, words=300):
    """Near copies of one long title beside long titles of their own."""
    rnd = random.Random(7)
    base = [f"b{k}" for k in range(words)]
    rows = []
    for i in range(n):
        own = [f"x{rnd.randrange(5000)}" for _ in range(words)]
        t = [rnd.choice(own) if rnd.random() < 0.03 else w for w in base] if i % 3 else own
        rows.append((i, " ".join(t), dt.date(2021, 1, 1) + dt.timedelta(days=rnd.randrange(9)), "s"))
    return rows


def test_long_titles_match_brute_force(spark):
    rows = long_copies(90)
    got = similar_survivors(spark.createDataFrame(rows, SCHEMA), "id", "title", "d")
    assert {r["id"] for r in got.collect()} == brute(rows)


def test_long_near_copies_are_no_pairs(spark, monkeypatch):
    """The pairs that are checked grow with the rows, not with their square."""
    checked = {}
    for n in (150, 600):
        total = []
        real = S.stored

        def counted(df, name, total=total, real=real):
            out = real(df, name)
            if name == "candidates":
                total.append(out.count())
            return out

        monkeypatch.setattr(S, "stored", counted)
        df = spark.createDataFrame(long_copies(n, 200), SCHEMA)
        similar_survivors(df, "id", "title", "d").count()
        monkeypatch.setattr(S, "stored", real)
        checked[n] = sum(total)
    assert checked[600] < 3 * 600 and checked[150] < 3 * 150


def test_scope_limits_the_comparison(spark):
    rows = titles(200, 4)
    got = similar_survivors(spark.createDataFrame(rows, SCHEMA), "id", "title", "d", scope="src")
    assert {r["id"] for r in got.collect()} == brute(rows, by_source=True)


def test_newer_wins_and_equal_dates_drop_the_later_row(spark):
    d1, d2 = dt.date(2021, 1, 1), dt.date(2021, 1, 2)
    base = "alpha beta gamma delta epsilon zeta eta theta"
    for dates, kept in (((d2, d1), 0), ((d1, d2), 1), ((d1, d1), 0)):
        rows = [(0, base, dates[0], "s"), (1, base + " iota", dates[1], "s")] + [(i, f"other{i} title{i}", d1, "s") for i in range(2, 5)]
        got = similar_survivors(spark.createDataFrame(rows, SCHEMA), "id", "title", "d")
        assert {r["id"] for r in got.collect()} == {kept, 2, 3, 4}


def test_dedupe_keeps_first_and_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (5, None), (4, "b")], "id long, t string")
    out = dedupe_first(df, ["t"], ["id"])
    assert {r["id"] for r in out.collect()} == {1, 2, 4}
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_sliced_join_equals_plain_join(spark):
    rows = spark.range(2000).selectExpr("id", "case when id % 3 = 0 then 'hot' else concat('k', id % 500) end as k")
    lookup = rows.select("k").distinct().selectExpr("k", "length(k) as v")
    counts = rows.groupBy("k").count().withColumnRenamed("count", "n")
    assert hot_keys(counts, ["k"]).count() <= 1000
    got = sliced_join(rows, lookup, ["k"], counts, "id", share=0.01)
    assert got.count() == 2000
    assert got.where("v != length(k)").count() == 0


def test_unlike_titles_are_no_candidates(spark):
    """Titles that share one word each with many others: candidates grow with the rows, not with the rows of a word."""
    n, rng = 1500, random.Random(5)
    rows = [(k, " ".join(f"w{w}" for w in rng.sample(range(300), 8)), "2024-01-01") for k in range(n)]
    cfg = Similarity()
    folded = S.fold_bags(S.bags(spark.createDataFrame(rows, "id long, title string, d string"), "id", "title", "d", None))
    vectors = S.unit_vectors(folded).join(folded.select("id", "rank"), "id").withColumn("prefix", S._prefix(cfg.threshold))
    assert S._candidates(vectors.select("id"), vectors, cfg).count() < n


def test_a_word_above_the_threshold_is_enough(spark):
    rows = [(1, "rare rare rare rare rare one", "2024-01-02"), (2, "rare rare rare rare rare two", "2024-01-01"), (3, "one two six", "2024-01-03"), (4, "rare", "2023-01-01")]
    df = spark.createDataFrame(rows, "id long, title string, d string")
    assert {r.id for r in similar_survivors(df, "id", "title", "d").collect()} == {1, 3}
