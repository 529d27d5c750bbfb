"""Byte-level BPE by padded numpy matrices, and its inverse.

The pieces that a batch has not met yet are dealt into matrices by length, one row a piece and one column a token. Each
round finds the leftmost pair of least rank in every row at once, merges it, closes the gap, and takes rows that are
done out of the matrix. Pair ranks come from a hash table in two numpy arrays. Only the two pairs beside a merge are
looked up again.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newstide.llm.units import UnitCache
from newstide.llm.worker import kept, release

NONE = np.int32(2**31 - 1)
MATRIX_LONGEST = 1024  # longer pieces are merged with a heap: a matrix takes as many rounds as a row has merges
MATRIX_CELLS = 1 << 20


class Ranks:
    """A rank file: the bytes of each id, and the rank of each pair of ids whose joined bytes have one."""

    def __init__(self, path: str):
        ranks = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = rank
        self.pairs = pairs
        self._hash(np.array([(a << 32) | b for a, b in pairs], np.int64), np.array(list(pairs.values()), np.int32))

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing: every key lies within ``self.reach`` slots after its own."""
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.values = np.full(len(self.keys), NONE, np.int32)
        slot, self.reach = self._slot(keys), 0
        todo = np.arange(len(keys))
        while len(todo):
            at = slot[todo] + self.reach
            free = self.keys[at] == -1
            taken, first = np.unique(at[free], return_index=True)
            put = todo[free][first]
            self.keys[taken], self.values[taken] = keys[put], values[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            self.reach += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` without one. A padding id of -1 has none."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        slot = self._slot(keys[todo])
        for step in range(self.reach):
            there = self.keys[slot + step]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[(slot + step)[hit]]
            go = ~hit & (there != -1)
            todo, slot = todo[go], slot[go]
            if not len(todo):
                break
        return out.reshape(shape)


def encode_pieces(pieces: Sequence[bytes], ranks: Ranks) -> list[bytes]:
    """The ids of each piece as little-endian unsigned 32-bit integers."""
    out: list[bytes] = [b""] * len(pieces)
    by_length = sorted(range(len(pieces)), key=lambda k: len(pieces[k]))
    at = 0
    while at < len(by_length):
        width = max(4, len(pieces[by_length[at]]))
        if width > MATRIX_LONGEST:
            out[by_length[at]] = _merge_long(pieces[by_length[at]], ranks)
            at += 1
            continue
        width = min(width + width // 2, MATRIX_LONGEST)
        end = at
        while end < len(by_length) and len(pieces[by_length[end]]) <= width and (end - at) * width < MATRIX_CELLS:
            end += 1
        rows = by_length[at:end]
        for row, ids in zip(rows, _merge_matrix([pieces[k] for k in rows], ranks), strict=True):
            out[row] = ids
        at = end
    return out


def _merge_matrix(pieces: list[bytes], ranks: Ranks) -> list[bytes]:
    length = np.array([len(p) for p in pieces])
    width = max(int(length.max()), 2)
    ids = np.full((len(pieces), width), -1, np.int32)
    inside = np.arange(width) < length[:, None]
    ids[inside] = ranks.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
    pair = ranks.rank(ids[:, :-1], ids[:, 1:])
    row = np.arange(len(pieces))
    out: list[bytes] = [b""] * len(pieces)
    while len(row):
        at = pair.argmin(1)
        least = pair[np.arange(len(row)), at]
        done = least == NONE
        if done.any():
            for k, n, line in zip(row[done], length[done], ids[done].astype("<u4"), strict=True):
                out[k] = line[:n].tobytes()
            row, length, at, least = (x[~done] for x in (row, length, at, least))
            if not len(row):
                break
            width = max(int(length.max()), 2)
            ids, pair = ids[~done, :width], pair[~done, : width - 1]
        lines, columns = np.arange(len(row)), np.arange(width)
        from_ = columns + (columns > at[:, None])  # the column behind a merge takes its right neighbour's place
        ids = np.take_along_axis(np.pad(ids, ((0, 0), (0, 1)), constant_values=-1), from_, 1)
        pair = np.take_along_axis(np.pad(pair, ((0, 0), (0, 2)), constant_values=NONE), from_, 1)[:, : width - 1]
        ids[lines, at] = least
        length = length - 1
        right = np.minimum(at, width - 2)
        pair[lines, right] = np.where(at == right, ranks.rank(ids[lines, right], ids[lines, right + 1]), pair[lines, right])
        before = np.flatnonzero(at > 0)
        pair[before, at[before] - 1] = ranks.rank(ids[before, at[before] - 1], ids[before, at[before]])
    return out


def _merge_long(piece: bytes, ranks: Ranks) -> bytes:
    """The same merges for one long piece: a heap of (rank, place) over a linked list."""
    ids = ranks.byte_id[np.frombuffer(piece, np.uint8)].tolist()
    n = len(ids)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, k) for k in range(n - 1) if (r := ranks.pairs.get((ids[k], ids[k + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, k = heapq.heappop(heap)
        j = right[k]
        if ids[k] < 0 or j >= n or ranks.pairs.get((ids[k], ids[j])) != rank:
            continue
        ids[k], ids[j] = rank, -1
        right[k] = right[j]
        if right[k] < n:
            left[right[k]] = k
        for a, b in ((left[k], k), (k, right[k])):
            if a >= 0 and b < n and (r := ranks.pairs.get((ids[a], ids[b]))) is not None:
                heapq.heappush(heap, (r, a))
    return np.array([x for x in ids if x >= 0], "<u4").tobytes()


def unit_encoder(ranks: Ranks, pattern: str):
    """Encodes units: each match of ``pattern`` apart, every distinct match once."""
    import regex

    find = regex.compile(pattern).findall

    def encode(units: list[str]) -> list[bytes]:
        matches = [find(u) for u in units]
        distinct = list({m for u in matches for m in u})
        ids = dict(zip(distinct, encode_pieces([m.encode() for m in distinct], ranks), strict=True))
        return [b"".join(map(ids.__getitem__, u)) for u in matches]

    return encode


def _bytes(ids: bytes, token: list[bytes]) -> bytes:
    return b"".join(map(token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", back: str | None = None) -> DataFrame:
    """Add ``out``, the ids of each whole text as little-endian unsigned 32-bit integers in one binary value.

    Every match of ``pattern`` (a ``regex`` pattern) is encoded apart by the ranks in the tiktoken file ``path``, a place
    each executor must have. There are no special tokens: their strings are ordinary text. With ``back`` the ids are
    decoded at once, in the same pass, into a binary column of that name. A null or empty text has no
    ids (an empty value). A column already called like a new one is replaced, all others stay. Rows are independent: ties,
    repeated rows and empty tables need no rule.
    """
    kind = f"struct<ids: binary{', back: binary' if back else ''}>"

    @F.arrow_udf(kind)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release("ranks", "bpe")
        ranks = kept(("ranks", path), lambda: Ranks(path))
        cache = kept(("bpe", path, pattern), lambda: UnitCache(unit_encoder(ranks, pattern)))
        for part in parts:
            ids = pa.array(cache.texts(x.as_py() for x in part), pa.binary())
            more = {"back": pa.array((_bytes(x.as_py(), ranks.bytes) for x in ids), pa.binary())} if back else {}
            yield pa.StructArray.from_arrays([ids, *more.values()], ["ids", *more])

    coded = docs.withColumn("_coded", run(F.col(text))).withColumn(out, F.col("_coded.ids"))
    return (coded.withColumn(back, F.col("_coded.back")) if back else coded).drop("_coded")


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the bytes that the ids stand for. Null ids give null; an id without a token is an error.

    A column already called ``out`` is replaced.
    """

    @F.arrow_udf("binary")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = kept(("ranks", path), lambda: Ranks(path)).bytes
        for part in parts:
            yield pa.array((_bytes(v, token) if (v := x.as_py()) is not None else None for x in part), pa.binary())

    return rows.withColumn(out, run(F.col(ids)))
