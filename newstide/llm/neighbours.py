"""Nearest neighbours by inner product: a few stable projections, indexed by a kd-tree, and a chi-square stopping test.

Vectors get one more component that gives them all the same norm; then the largest inner product is the smallest
Euclidean distance. The squared distance of two projections over the squared distance of the vectors follows a
chi-square law with as many degrees of freedom as there are projections. So once the next projection is further away
than the law allows, with probability ``sure``, for a vector as near as the k-th found, the search stops.

The tree is fitted on a bounded sample and has a bounded number of cells; every vector is in one of them. A query first
visits the cells nearest to it, which gives the distance of its k-th neighbour, then all cells that the test still
allows. Cells are cut into blocks of bounded size, and so are the queries that visit one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newstide.operators.skew import stored


@dataclass(frozen=True)
class Search:
    projections: int = 8  # even
    sure: float = 0.97
    sample: int = 20_000  # rows that the tree is fitted on
    most_cells: int = 4096
    cell_rows: int = 1024  # wanted per cell
    block: int = 4096  # vectors of a cell in one task
    queries: int = 2048  # queries of a block in one task
    first: int = 2  # cells that a query visits first
    seed: int = 20


def chi_square_bound(freedom: int, sure: float) -> float:
    """The value that a chi-square variable of an even number of degrees of freedom stays below with probability ``sure``."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(freedom // 2))
    low, high = 0.0, 1.0
    while below(high) < sure:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < sure else (low, mid)
    return high


@dataclass
class Tree:
    """Splits of a kd-tree by number: children of node k are 2k + 1 and 2k + 2; a leaf has no split (dimension -1)."""

    dimension: np.ndarray
    cut: np.ndarray

    @classmethod
    def fit(cls, points: np.ndarray, cells: int) -> Tree:
        depth = max(0, math.ceil(math.log2(max(cells, 1))))
        size = 2 ** (depth + 1) - 1
        tree = cls(np.full(size, -1), np.zeros(size))
        rows = [(0, np.arange(len(points)), 0)]
        while rows:
            node, own, level = rows.pop()
            if level == depth or len(own) < 2:
                continue
            spread = points[own].max(0) - points[own].min(0)
            d = int(spread.argmax())
            cut = float(np.median(points[own, d]))
            right = points[own, d] > cut
            if not right.any():  # more than half have the largest value
                cut = float(np.nextafter(cut, -np.inf))
                right = points[own, d] > cut
            if right.all() or not right.any():
                continue
            tree.dimension[node], tree.cut[node] = d, cut
            rows += [(2 * node + 1, own[~right], level + 1), (2 * node + 2, own[right], level + 1)]
        return tree

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        while True:
            d = self.dimension[node]
            inner = d >= 0
            if not inner.any():
                return node
            right = points[np.arange(len(points)), np.maximum(d, 0)] > self.cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not zero, all components there and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the same order for every row, so that equal vectors tie."""
    return (vectors * query).sum(1)


def _best(ids: np.ndarray, vectors: np.ndarray, q_id: int, q: np.ndarray, rough: np.ndarray, k: int) -> list[tuple[int, float]]:
    """The k best of the rows with a finite rough score, by exact score, ties to the smaller id."""
    rough = np.where(ids == q_id, -np.inf, rough)
    there = np.flatnonzero(rough > -np.inf)
    if len(there) > k:
        least = np.partition(rough[there], len(there) - k)[len(there) - k]
        there = there[rough[there] >= least - 1e-9 * max(1.0, abs(least))]
    exact = scores(q, vectors[there])
    order = np.lexsort((ids[there], -exact))[:k]
    return [(int(ids[there[o]]), float(exact[o])) for o in order]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding", how: Search = Search()) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each query the ``k`` rows of largest inner product that were found.

    Scores are exact and ties go to the smaller id; whether a true neighbour is found is a matter of chance, at least
    ``how.sure`` for each. Vectors that are not ``usable``, rows without an id, and vectors of another length than the
    most frequent one (of equally frequent ones the longer) take no part. Rows with the query's id are not its
    neighbours; of queries that repeat an id one is asked. Other columns are dropped. Without vectors there are no rows.
    """
    all_rows = vectors.where(F.col(id).isNotNull() & usable(F.col(vector))).select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks"))
    length = all_rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d, n, norm = length["d"], length["n"], length["norm"]
    m, bound = how.projections, chi_square_bound(how.projections, how.sure)
    axes = np.random.default_rng(how.seed).normal(size=(d + 1, m))

    def project(v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(norm - (v * v).sum(1), 0.0))]) @ axes

    rows = all_rows.where(F.size("v") == d)
    some = rows.select("v").orderBy(F.xxhash64("id"), "id").limit(how.sample).toArrow()
    tree = Tree.fit(project(_matrix(some["v"])), min(how.most_cells, math.ceil(n / how.cell_rows)))

    def index(batches):
        for b in batches:
            v = _matrix(b.column(1))
            p = project(v) if len(v) else np.zeros((0, m))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.cells(p)), pa.array(list(p), pa.list_(pa.float64()))], ["id", "v", "asks", "cell", "p"])

    placed = stored(rows.mapInArrow(index, "id long, v array<double>, asks boolean, cell long, p array<double>"), "index")
    ends = [F.min(F.col("p")[i]).alias(f"lo{i}") for i in range(m)] + [F.max(F.col("p")[i]).alias(f"hi{i}") for i in range(m)]
    boxes = sorted(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ends).collect())  # a row for each cell of the tree
    cell = np.array([b["cell"] for b in boxes])
    low, high = (np.array([[b[f"{e}{i}"] for i in range(m)] for b in boxes]) for e in ("lo", "hi"))
    queries = placed.where("asks").dropDuplicates(["id"]).select("id", "v")

    def gaps(p: np.ndarray) -> np.ndarray:
        """Squared distance of each query's projection from the box of each cell."""
        off = np.maximum(low[None] - p[:, None], 0) + np.maximum(p[:, None] - high[None], 0)
        return (off * off).sum(2)

    def visits(second: bool):
        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    v = _matrix(part.column(1))
                    p = np.column_stack([v, np.zeros(len(v))]) @ axes
                    near = gaps(p)
                    order = np.argsort(near, 1, kind="stable")
                    ranks = np.empty_like(order)
                    np.put_along_axis(ranks, order, np.arange(len(cell))[None], 1)
                    reach, least = np.full(len(v), np.inf), np.full(len(v), -np.inf)
                    go = ranks < how.first
                    if second:
                        reach = np.array([np.inf if x is None else x for x in part.column(2).to_pylist()])
                        least = np.array([-np.inf if x is None else x for x in part.column(3).to_pylist()])
                        go = ~go & (near <= reach[:, None])
                    row, column = np.nonzero(go)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(list(p[row]), pa.list_(pa.float64())), pa.array(reach[row]), pa.array(least[row]), pa.array(cell[column])],
                        ["id", "v", "p", "reach", "least", "cell"],
                    )

        return run

    def verify(key, block: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if block.num_rows and asked.num_rows:
            ids, v, p = block["id"].to_numpy(), _matrix(block["v"]), _matrix(block["p"])
            q, pq, reach = _matrix(asked["v"]), _matrix(asked["p"]), asked["reach"].to_numpy()
            least = asked["least"].to_numpy()
            least = least - 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(least), least, 0.0)))
            for at in range(0, len(q), 256):
                part = slice(at, at + 256)
                off = (pq[part] ** 2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * pq[part] @ p.T
                rough = np.where(off <= reach[part][:, None] + 1e-9, q[part] @ v.T, -np.inf)
                rough = np.where(rough >= least[part][:, None], rough, -np.inf)  # what is no better than the k-th found stays here
                for k_, (q_id, row) in enumerate(zip(asked["id"][at : at + 256].to_pylist(), rough, strict=True)):
                    out += [(q_id, i, s) for i, s in _best(ids, v, q_id, q[at + k_], row, k)]
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score"), columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    def search(asked: DataFrame) -> DataFrame:
        asked = stored(asked, "visits")
        load = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / how.queries).cast("int").alias("lanes"))
        cut = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / how.block).cast("int").alias("blocks"))
        both = F.broadcast(stored(load.join(cut, "cell"), "cells"))  # a row for each cell of the tree at most
        left = placed.select("id", "v", "p", "cell").join(both, "cell").withColumn("b", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
        right = asked.join(both, "cell").withColumn("lane", F.pmod(F.xxhash64("id"), "lanes").cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keys = ["cell", "b", "lane"]
        return left.drop("lanes", "blocks").groupBy(*keys).cogroup(right.drop("lanes", "blocks").groupBy(*keys)).applyInArrow(verify, "query_id long, vec_id long, score double")

    def top(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    asks = "id long, v array<double>, p array<double>, reach double, least double, cell long"
    begun = stored(top(search(queries.mapInArrow(visits(False), asks))), "begun")
    # the squared distance of the k-th found is norm + |q|^2 - 2 score; a longer list of bounds would only shrink it
    kth = begun.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    reach = F.greatest(F.lit(norm) + squared - 2 * F.col("kth"), F.lit(0.0)) * bound
    again = queries.join(kth, "id", "left").select("id", "v", reach.alias("reach"), "kth")
    more = search(again.mapInArrow(visits(True), asks))
    return top(begun.select("query_id", "vec_id", "score").unionByName(more)).select("query_id", "rank", "vec_id", "score")
