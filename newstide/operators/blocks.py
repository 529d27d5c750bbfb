"""Sums of products of many columns, accumulated as matrices one Arrow batch at a time.

For k columns a batch costs four k x k matrix products instead of k * k / 2 rows, and a task returns one set of sums a group,
whatever the number of its rows. Sums are kept for each pair of columns over the rows that hold both.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HELD = 64 << 20  # bytes of matrices that a task keeps before it passes them on
SUMS = ("n", "si", "sj", "sii", "sjj", "sij")


def _matrices(values: np.ndarray) -> np.ndarray:
    """Counts, sums, sums of squares (each of the row's column where the other column is there) and sums of products."""
    there = ~np.isnan(values)
    x, m = np.where(there, values, 0.0), there.astype(float)
    return np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])


def block_sums(df: DataFrame, vector: Column, by: Sequence[str] = ()) -> DataFrame:
    """For each group and pair i <= j of places of an array column: rows with both, and the sums of i, j, their squares and product.

    All arrays have the same length; a missing or NaN value leaves its row out of the pairs it is in.
    """
    rows = df.select(*by, vector.cast("array<double>").alias("_v"))
    fields = [f for f in rows.schema.fields if f.name != "_v"]
    types = ["int", "int", "bigint", *["double"] * 5]
    schema = T.StructType([*fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in zip(("i", "j", *SUMS), types, strict=True)]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for key, (n, s, q, p) in held.items():
                i, j = np.triu_indices(len(n))
                cells = [i.astype("i4"), j.astype("i4"), np.rint(n[i, j]).astype("i8"), s[i, j], s[j, i], q[i, j], q[j, i], p[i, j]]
                groups = [pa.array([k] * len(i), kind) for k, kind in zip(key, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*groups, *map(pa.array, cells)], [f.name for f in schema.fields])
            held.clear()

        for batch in batches:
            kinds = [c.type for c in batch.columns[:-1]]
            lists = batch.column(batch.num_columns - 1)
            if not len(lists):
                continue
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)
            keys = list(zip(*[c.to_pylist() for c in batch.columns[:-1]], strict=True)) if kinds else [()] * len(lists)
            number: dict[tuple, int] = {}
            codes = np.fromiter((number.setdefault(k, len(number)) for k in keys), np.int64, len(keys))
            order = np.argsort(codes, kind="stable")
            cuts = np.searchsorted(codes[order], np.arange(len(number) + 1))
            for key, a, b in zip(number, cuts, cuts[1:], strict=False):
                more = _matrices(values[order[a:b]])
                held[key] = held[key] + more if key in held else more
            if len(held) * 32 * values.shape[1] ** 2 > HELD:
                yield from flush()
        yield from flush()

    found = rows.mapInArrow(run, schema)
    return found.groupBy(*by, "i", "j").agg(*[F.sum(c).alias(c) for c in SUMS])


def correlations(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of each pair of columns over the rows that hold both: ``by``, left, right, correlation, n.

    It is null where a column of the pair does not vary. Values are shifted by the column's mean first, so that a large level
    does not cancel; for that ``df`` is read twice. Store it before if it is costly.
    """
    names = list(cols)
    means = df.agg(*[F.avg(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None))).alias(str(k)) for k, c in enumerate(names)]).first()
    shifted = F.array(*[F.col(f"`{c}`").cast("double") - F.lit(float(means[k] or 0.0)) for k, c in enumerate(names)])
    sums = block_sums(df, shifted, by).where(F.col("i") < F.col("j"))
    n = F.col("n").cast("double")

    def spread(s: str, q: str) -> Column:
        whole = n * F.col(q)
        gap = whole - F.col(s) * F.col(s)
        return F.when(gap > 1e-12 * whole, gap)

    labels = F.array(*[F.lit(c) for c in names])
    r = (n * F.col("sij") - F.col("si") * F.col("sj")) / F.sqrt(spread("si", "sii") * spread("sj", "sjj"))
    return sums.select(*by, F.get(labels, F.col("i")).alias("left"), F.get(labels, F.col("j")).alias("right"), r.alias("correlation"), "n")
