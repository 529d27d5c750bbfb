"""What filters remove in every order they can be applied in, by merging sorted lists of the ids that fail each.

Rows are reduced to small entries first: part, id, which filters fail, which marks hold. Entries are dealt out by ranges of
(part, id), so a large part is spread over many tasks. Inside a task each part's entries of a bounded id range give one sorted
list of failing ids a filter. Unions of lists and their differences by galloping search give the sums of that range, which
Spark adds up; no list leaves its task. The number of sums of a range depends on the number of filters only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newstide.llm.quality import _once, words
from newstide.operators.skew import sliced_join, stored

MOST_FILTERS = 7  # 7! orders of 7 steps are 35,280 rows a part


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What the sorted list ``a`` holds and the sorted list ``b`` does not: the shorter one gallops through the longer."""
    if not len(a) or not len(b):
        return a
    if len(a) <= len(b):
        return a[b[np.minimum(np.searchsorted(b, a), len(b) - 1)] != a]
    at = np.searchsorted(a, b)
    at, b = at[at < len(a)], b[at < len(a)]
    stays = np.ones(len(a), bool)
    stays[at[a[at] == b]] = False
    return a[stays]


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both sorted lists, which have nothing in common, as one."""
    return np.insert(a, np.searchsorted(a, b), b) if len(b) else a


def unions(lists: Sequence[np.ndarray]) -> list[np.ndarray]:
    """By set of lists (bit f is list f) the sorted union of its lists."""
    out = [np.zeros(0, np.int64)]
    for s in range(1, 1 << len(lists)):
        last = s.bit_length() - 1
        rest = out[s ^ (1 << last)]
        out.append(merged(rest, minus(lists[last], rest)))
    return out


def range_sums(lists: Sequence[np.ndarray], weight: np.ndarray, marks: Sequence[np.ndarray]) -> Iterator[tuple[int, ...]]:
    """Sums of one id range, for each filter and set of filters before it: filter, set, rows, rows gone after it, rows removed, its
    failing rows, those that fail nothing else, its share over all orders, and removed rows with each mark.

    Lists hold positions into ``weight``, the rows an entry stands for. The share adds up what the filter removes over all orders.
    """
    k, gone = len(lists), unions(lists)
    size = lambda x: int(weight[x].sum())
    total, sizes = int(weight.sum()), [size(x) for x in gone]
    for f in range(k):
        sets = [s for s in range(1 << k) if not s >> f & 1]
        lost = {s: minus(lists[f], gone[s]) for s in sets}
        removed = {s: size(x) for s, x in lost.items()}
        share = sum(removed[s] * factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) for s in sets)
        for s in sets:
            with_mark = [size(x[m[x]]) for m in marks for x in (lost[s],)]
            yield f, s, total, sizes[s] + removed[s], removed[s], removed[0], removed[sets[-1]], share, *with_mark


SUMS = ("total", "gone", "removed", "fails", "alone", "share")


def entry_sums(entries: DataFrame, filters: int, marks: Sequence[str]) -> DataFrame:
    """Sums by part, filter and the set of filters before it, from ``entries``: part, id, tie, fails (bits), weight and the marks.

    ``tie`` is anything that tells entries of one id apart; it lets ranges cut through an id with very many entries.
    """
    names = [*SUMS, *marks]
    schema = "part string, filter int, before int, " + ", ".join(f"`{n}` bigint" for n in names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [pa.field("part", pa.string()), pa.field("filter", pa.int32()), pa.field("before", pa.int32()), *[pa.field(n, pa.int64()) for n in names]]
        for batch in batches:  # a range of ids in order
            part = np.array(batch.column("part").to_pylist(), object)
            fails, weight = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("fails", "weight"))
            held = [batch.column(n).to_numpy(zero_copy_only=False).astype(bool) for n in marks]
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            rows = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    lists = [np.flatnonzero(fails[a:b] >> f & 1) for f in range(filters)]
                    rows += [(part[a], *sums) for sums in range_sums(lists, weight[a:b], [h[a:b] for h in held])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))

    dealt = entries.repartitionByRange("part", "id", "tie").sortWithinPartitions("part", "id", "tie")
    found = dealt.select("part", "fails", "weight", *marks).mapInArrow(run, schema)
    return found.groupBy("part", "filter", "before").agg(*[F.sum(n).alias(n) for n in names])


def audit(entries: DataFrame, filters: Sequence[str], marks: Sequence[str] = ()) -> DataFrame:
    """One row for each part, order of the filters (one letter each) and step, with what the step's filter does there.

    part, filter_order, step (int, from 1), then long: kept, removed, redundant (rows that fail the filter and were removed
    earlier), unique_fails (rows that fail no other filter), ``<mark>_lost`` (removed rows with the mark), shapley (what the
    filter removes, added up over all orders). Rows without failures count as kept. No entries, no rows.
    """
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"from 1 to {MOST_FILTERS} filters")
    spark = entries.sparkSession
    bit = {f: 1 << k for k, f in enumerate(filters)}
    steps = [("".join(o), k + 1, filters.index(f), sum(bit[x] for x in o[:k])) for o in permutations(filters) for k, f in enumerate(o)]
    orders = spark.createDataFrame(steps, "filter_order string, step int, filter int, before int")  # bounded by MOST_FILTERS
    sums = entry_sums(entries, len(filters), marks)
    out = sums.join(F.broadcast(orders), ["filter", "before"])
    return out.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.col("gone")).alias("kept"),
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        F.col("alone").alias("unique_fails"),
        *[F.col(m).alias(f"{m}_lost") for m in marks],
        F.col("share").alias("shapley"),
    )


def text_failures(text: Column) -> dict[str, Column]:
    """A: under 50 words; B: under 65 distinct words of 100; C: over 5 of 100 characters A-Z; D: any of # $ % & * |. A null is empty."""
    whole = F.coalesce(text, F.lit(""))
    sizes = _once(words(whole), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    upper = F.length(whole) - F.length(F.regexp_replace(whole, "[A-Z]+", ""))
    return {
        "A": _once(sizes, lambda s: F.array(s["n"] < 50, 100 * s["d"].cast("long") < 65 * s["n"].cast("long"))),
        "C": 100 * upper.cast("long") > 5 * F.length(whole).cast("long"),
        "D": whole.rlike("[#$%&*|]"),
    }


def entries(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", marks: Mapping[str, str] | None = None) -> DataFrame:
    """Entries for ``audit`` with the filters A to D of ``text_failures`` and E, a text equal to that of any smaller id.

    A null part is the empty string. ``marks`` names columns of ``labels``; a mark holds for an id if any of its label rows has 1
    there. Each row counts, repeated ones too. Rows without an id have no smaller id, are smaller than none and have no labels.
    Texts are compared by their SHA-256.
    """
    marks = {"good": "quality", "toxic": "toxic"} if marks is None else marks
    whole = F.coalesce(F.col(text), F.lit(""))
    flags = text_failures(F.col(text))
    rows = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(doc_id).alias("id"), F.unhex(F.sha2(whole, 256)).alias("tie"), flags["A"].alias("words"), flags["C"].alias("c"), flags["D"].alias("d"))
    bits = F.col("words")[0].cast("int") + 2 * F.col("words")[1].cast("int") + 4 * F.col("c").cast("int") + 8 * F.col("d").cast("int")
    small = stored(rows.select("part", "id", "tie", bits.alias("fails")).groupBy("part", "id", "tie", "fails").agg(F.count(F.lit(1)).alias("weight")), "audit-rows")
    copies = stored(small.groupBy("tie").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).where("n > 1"), "audit-copies")
    known = sliced_join(small, copies.drop("n"), ["tie"], copies.drop("least"), "id", how="left")
    later = F.coalesce(F.col("id") > F.col("least"), F.lit(False)).cast("int")
    judged = known.select("part", "id", "tie", (F.col("fails") + 16 * later).alias("fails"), "weight")
    held = labels.groupBy(F.col(doc_id).alias("id")).agg(*[F.max((F.col(c) == 1).cast("int")).alias(m) for m, c in marks.items()])
    both = judged.join(held, "id", "left")
    return stored(both.select("part", "id", "tie", "fails", "weight", *[(F.coalesce(m, F.lit(0)) == 1).alias(m) for m in marks]), "audit-entries")
