"""Writers: one folder per key, JSON summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newstide.operators.skew import stored


def write_by_key(
    df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], fmt: str = "csv", file_bytes: int = 128 << 20
) -> None:
    """One folder per key, sorted by ``order``: one file each, or as many as its bytes of text need.

    Bytes are counted first. A key above ``file_bytes`` is cut in ranges of ``order``, which are written by tasks of their own, so
    its files follow each other; the rows of all other keys are dealt by key. Rows that are equal in ``order`` stay together.
    """
    size = reduce(add, [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 1 for c in df.columns])
    sizes = stored(df.groupBy(*keys).agg(F.sum(size).alias("_bytes")), "key-bytes")
    large = sizes.where(F.col("_bytes") > file_bytes)
    files = large.agg(F.sum(F.ceil(F.col("_bytes") / file_bytes))).first()[0]
    same = reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)])
    named = large.select(*[F.col(f"`{k}`").alias(f"_k{n}") for n, k in enumerate(keys)])
    rest = df.join(named, same, "left_anti") if files else df
    parts = rest.repartition(*keys).sortWithinPartitions(*keys, *order)
    if files:
        cut = df.join(named, same, "left_semi").repartitionByRange(int(files), *keys, *order)
        parts = parts.unionByName(cut.sortWithinPartitions(*keys, *order))
    parts.write.partitionBy(*keys).options(header=True, encoding="UTF-8", escape='"').format(fmt).save(path)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON document."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)
