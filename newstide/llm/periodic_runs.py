"""Runs of words that repeat with a period, found by seeds on diagonals and extended to their full length.

A run of smallest period q and length max(24, 3 * q) or more agrees with itself q words later over max(24 - q, 2 * q) words.
So for lags below 16 any run holds two equal grams of 16 words a lag apart, and for lags from w to 2 * w, w = 16, 32, ..., two
equal grams of 2 * w words. Grams of the same text are indexed by sorting their hashes; each pair of occurrences whose lag is in
the range of its width is a seed. Pairs on one diagonal that touch are one seed, and a table of the furthest word covered on each
diagonal keeps a match from being extended again.

From the second width on a gram that comes again after an eighth of its width or less is no seed: it lies inside a run of a
shorter period, and a run with only such grams would have that period. All other grams come at most eight times within their own
length, so the pairs of a text are at most a fixed number for each word and width, whatever repeats in it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newstide.llm.quality import _once, words
from newstide.llm.shingles import GOLDEN, mix

SEED = 16  # the shortest match of a run with itself: max(24 - q, 2 * q) is least at q = 8
LEAST, TIMES = 24, 3  # a run has at least so many words and repetitions
CHUNK = 1 << 20

Run = tuple[int, int, int]  # start, length, period


def _doubled(grams: np.ndarray, width: int) -> np.ndarray:
    """Hashes of grams of twice the width."""
    return mix(grams[: len(grams) - width] * GOLDEN + grams[width:])


def _seeds(place: np.ndarray, gram: np.ndarray, doc: np.ndarray, width: int, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and lags (from ``low`` to below ``width``) of equal grams, and the positions with another one in their text."""
    order = np.argsort(gram, kind="stable")  # equal grams in the order of their positions
    place, gram, doc = place[order], gram[order], doc[order]
    same = (gram[1:] == gram[:-1]) & (doc[1:] == doc[:-1])
    again = np.zeros(len(place), bool)
    again[1:] |= same
    again[:-1] |= same
    gap = place[1:] - place[:-1]
    x = np.flatnonzero(same & (gap < width) & ((gap > width // 8) if width > SEED else True))
    starts, lags, step = [], [], 1
    while len(x):
        lag = place[x + step] - place[x]
        near = (gram[x + step] == gram[x]) & (lag < width)  # a lag below the width stays in the text
        x, lag = x[near], lag[near]
        starts.append(place[x[lag >= low]])
        lags.append(lag[lag >= low])
        step += 1
        x = x[x + step < len(place)]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *lags]), np.sort(place[again])


def _reach(ids: np.ndarray, at: int, lag: int) -> int:
    """The first position from ``at`` on whose word differs from the one ``lag`` later. Marks between texts end the search."""
    step = 64
    while True:
        right = ids[at + lag : at + lag + step]
        differ = ids[at : at + len(right)] != right
        if differ.any():
            return at + int(differ.argmax())
        at += step
        step *= 2


def _back(ids: np.ndarray, at: int, lag: int) -> int:
    """The first position of the stretch up to ``at`` whose words equal those ``lag`` later."""
    step = 64
    while True:
        first = max(0, at - step)
        differ = ids[first:at] != ids[first + lag : at + lag]
        if differ.any():
            return at - int(differ[::-1].argmax())
        at = first
        step *= 2


def find_runs(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """First position, length and period of each run in numbered words.

    Text k has the words ``ids[begins[k]:ends[k]]``; before the first, between any two and after the last stands a number that
    occurs nowhere else.
    """
    if len(ids) < LEAST:
        return []
    sizes = ends - begins
    doc = np.repeat(np.arange(len(sizes)), sizes + 1)  # by position from the first text on, each with the mark after it
    left = np.repeat(ends, sizes + 1) - np.arange(begins[0], begins[0] + len(doc))
    doc, left = np.concatenate([[0], doc]), np.concatenate([[0], left])
    grams, width = mix((ids.astype(np.uint64) + np.uint64(1)) * GOLDEN), 1
    while width < SEED:
        grams, width = _doubled(grams, width), 2 * width
    place, low = np.flatnonzero(left[: len(grams)] >= SEED), 1
    found: dict[tuple[int, int], int] = {}
    while len(place) > 1:
        starts, lags, place = _seeds(place, grams[place], doc[place], width, low)
        order = np.lexsort((starts, lags))
        starts, lags = starts[order], lags[order]
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (lags[1:] != lags[:-1]) | (starts[1:] - starts[:-1] > width)
        furthest: dict[int, int] = {}
        for at, lag in zip(starts[fresh].tolist(), lags[fresh].tolist(), strict=True):
            if at < furthest.get(lag, 0):
                continue
            end, first = _reach(ids, at, lag), _back(ids, at, lag)
            furthest[lag] = end
            length = end - first + lag
            if length >= max(LEAST, TIMES * lag):
                key = first, length
                found[key] = min(lag, found.get(key, lag))  # a multiple of the period spans the same words
        low, place = width, place[(left[place] >= 2 * width) & (sizes[doc[place]] >= TIMES * width)]
        if len(place) > 1:
            grams, width = _doubled(grams, width), 2 * width
    return sorted((first, length, lag) for (first, length), lag in found.items())


def text_runs(texts: Iterable[bytes | None]) -> Iterator[tuple[list[bytes], list[Run]]]:
    """The words and runs of each text, a bounded number of bytes (or one text) at a time."""
    some: list[list[bytes]] = []
    size = 0
    for text in texts:
        some.append((text or b"").split())  # at ASCII white space
        size += len(text or b"")
        if size >= CHUNK:
            yield from _chunk_runs(some)
            some, size = [], 0
    yield from _chunk_runs(some)


def _chunk_runs(texts: list[list[bytes]]) -> Iterator[tuple[list[bytes], list[Run]]]:
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    parts, begins, ends, at = [np.array([-1])], [], [], 1
    for k, text in enumerate(texts):
        begins.append(at)
        at += len(text) + 1
        ends.append(at - 1)
        parts += [np.fromiter(map(number.__getitem__, text), np.int64, len(text)), np.array([-2 - k])]
    runs: list[list[Run]] = [[] for _ in texts]
    if texts:
        first = np.array(begins)
        for start, length, period in find_runs(np.concatenate(parts), first, np.array(ends)):
            k = int(np.searchsorted(first, start, "right")) - 1
            runs[k].append((start - begins[k], length, period))
    for text, found in zip(texts, runs, strict=True):
        yield text, sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(text: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(text)
    keep = np.ones(len(text), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([text[k] for k in np.flatnonzero(keep).tolist()])


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words (long), runs (an array of start, length, period, by start, then period) and collapsed (the text without repeats).

    Words are runs of other characters than ASCII white space, numbered from 0 and compared exactly. A null or empty text has
    no words, no runs and an empty ``collapsed``. Columns called like a new one are replaced, all others stay. Rows are
    independent of each other, so repeated rows get the same result and an empty table gives an empty one.
    """

    @F.arrow_udf("struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: binary>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            sizes, runs, rest = [], [], []
            for tokens, found in text_runs(x.as_py() for x in part):
                sizes.append(len(tokens))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                rest.append(collapsed(tokens, found))
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(runs, RUNS), pa.array(rest, pa.binary())], ["n_words", "runs", "collapsed"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), run(F.col(text).cast("binary")).alias("new"))
    made = rows.withColumn("new", F.col("new").withField("collapsed", F.col("new.collapsed").cast("string")))
    return made.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_words", "runs", "collapsed")], "new.*")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period (compared exactly), then the smallest start, then period; null without runs."""

    def better(best: Column, x: Column) -> Column:
        mine, its = x["length"] * best["period"], best["length"] * x["period"]
        first = (x["start"] < best["start"]) | ((x["start"] == best["start"]) & (x["period"] < best["period"]))
        return F.when((mine > its) | ((mine == its) & first), x).otherwise(best)

    return F.when(F.size(runs) > 0, F.aggregate(runs, runs[0], better))


def listed(runs: Column) -> Column:
    """One line ``start,length,period`` for each run."""
    return F.array_join(F.transform(runs, lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")


def repeated_tail(text: Column, key: Column) -> Column:
    """For one key in ten the words from some word on repeat with some period, both picked by crc32 of the key as text.

    With h the checksum, g = h / 10 and n words, word i >= a = g % n becomes word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8),
    whole parts. Other texts, those without words and those without a key stay as they are.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        pick = lambda p, a: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(_once(p, lambda p: _once(a, lambda a: pick(p, a))), " ")).otherwise(F.lit(""))

    return F.when(h % 10 == 0, _once(words(F.coalesce(text, F.lit(""))), tail)).otherwise(text)
