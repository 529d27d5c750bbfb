"""Neighbours against brute force: exact scores and order, and recall."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from newstide.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids, m = np.array([i for i, _ in good]), np.array([v for _, v in good])
    out = {}
    for i, q in good:
        if i % 20 == 0:
            s = nb.scores(q, m)
            keep = ids != i
            order = np.lexsort((ids[keep], -s[keep]))[:k]
            out[i] = [(int(ids[keep][o]), float(s[keep][o])) for o in order]
    return out


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in nb.nearest(df, F.col("vec_id") % 20 == 0, how=nb.Search(**how)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def data(n, hot=0):
    dice = np.random.default_rng(n)
    centres = dice.normal(size=(8, 24))
    rows = [(k, (centres[k % 8] + 0.7 * dice.normal(size=24)).tolist(), 0) for k in range(n)]
    return rows + [(n + k, [0.5] * 12 + [-0.25] * 12, 0) for k in range(hot)]


def test_recall_and_exact_scores(spark):
    rows = data(3000, hot=400)
    right, got = brute(rows, 20), found(spark, rows, cell_rows=64, block=50, queries=16)
    assert right.keys() == got.keys()
    hits = [len({i for i, _ in right[q]} & {i for i, _ in got[q]}) / 20 for q in right]
    assert np.mean(hits) >= 0.93
    by_id = {r[0]: np.array(r[1], np.float32).astype(float) for r in rows}
    for q, held in got.items():
        assert held == sorted(held, key=lambda x: (-x[1], x[0])) and all(s == pytest.approx(float(by_id[q] @ by_id[i]), abs=1e-9) for i, s in held)
        if q >= 3000:  # equal vectors: the smallest ids
            assert held == right[q]


def test_few_and_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], 1), (20, [0.0, 0.0], 1), (40, None, 1), (60, [1.0, None], 1), (80, [float("nan"), 1.0], 1), (100, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (3, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (120, [-1.0, 0.5], 1), (7, [], 1)]
    assert found(spark, rows) == brute(rows, 20)
    assert found(spark, []) == {} and found(spark, [(1, [1.0], 0)]) == {}
    assert found(spark, [(20, [1.0], 0)]) == {}


def test_bound():
    dice = np.random.default_rng(0)
    assert ((dice.normal(size=(200_000, 8)) ** 2).sum(1) <= nb.chi_square_bound(8, 0.97)).mean() == pytest.approx(0.97, abs=0.003)


def test_tree_cells_hold_every_point():
    points = np.random.default_rng(1).normal(size=(1000, 4))
    points[:600] = points[0]
    tree = nb.Tree.fit(points, 16)
    assert len(set(tree.cells(points).tolist())) > 4 and (tree.cells(points[:600]) == tree.cells(points[:1])[0]).all()
