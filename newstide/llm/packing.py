"""Packing documents into windows of fixed length by the sum-of-squares rule.

Each task keeps a level array: how many of its open windows are filled up to each level. A document goes to the level
that keeps the sum of the squared counts least. Full windows leave at once, so that a task holds open windows only.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from newstide.llm.units import UnitCache
from newstide.llm.worker import kept, release

WINDOW = 2048


class LevelArray:
    """Open windows by fill level. ``place`` returns the level a piece should join, 0 for a new window."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)  # the counts of empty and full windows stay 0
        self.open: list[list[list]] = [[] for _ in range(window)]  # by level, windows: lists of pieces

    def place(self, length: int) -> int:
        """Moving a window from h to h + length changes the sum of squares by 2 (N[h + length] - N[h]) + 2.

        A new window changes it by 2 N[length] + 1, a window that becomes full by 1 - 2 N[h]. Ties go to the fuller
        window.
        """
        room = self.window - length
        change = 2 * (self.count[length:] - self.count[: room + 1]) + 2  # by h, from 0 to room
        change[0] -= 1
        if room:
            change[room] -= 1
        change[1:][self.count[1 : room + 1] == 0] = np.iinfo(np.int64).max
        return room - int(change[::-1].argmin())

    def add(self, piece: tuple, length: int) -> list | None:
        """Put a piece into a window; returns the window's pieces if it is full now."""
        level = self.place(length)
        held = []
        if level:
            held = self.open[level].pop()
            self.count[level] -= 1
        held.append(piece)
        if level + length == self.window:
            return held
        self.open[level + length].append(held)
        self.count[level + length] += 1
        return None

    def pour(self) -> Iterator[list]:
        """Close all: the pieces of the emptiest windows are cut to fill up the fullest, one window stays partly filled."""
        held = [w for level in self.open for w in level]  # from the emptiest to the fullest
        loose: list[tuple] = []
        low, high = 0, len(held) - 1
        while low <= high:
            window = held[high]
            room = self.window - sum(p[2] for p in window)
            while room and (loose or low < high):
                if not loose:
                    loose = held[low][::-1]
                    low += 1
                row, start, length = loose.pop()
                if length > room:
                    loose.append((row, start + room, length - room))
                    length = room
                window.append((row, start, length))
                room -= length
            yield window
            high -= 1
        while loose:
            window, room = [], self.window
            while room and loose:
                row, start, length = loose.pop()
                if length > room:
                    loose.append((row, start + room, length - room))
                    length = room
                window.append((row, start, length))
                room -= length
            yield window


def hf_encoder(path: str):
    """Encodes units with ``tokenizers``, many joined to one string, and cuts the ids by the number of bytes they stand for."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    tokenizer = Tokenizer.from_file(path)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    vocab = tokenizer.get_vocab()
    size = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, k in vocab.items():  # byte-level vocabularies write a token with one character a byte
        size[k] = len(token)

    def apart(units: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def encode(units: list[str]) -> list[bytes]:
        plain = [u[:1] == " " and not u[-1:].isspace() and not any(s in u for s in special) for u in units]
        joined = [u for u, x in zip(units, plain, strict=True) if x]
        some = [joined[at : at + 512] for at in range(0, len(joined), 512)]
        found = []
        for few, e in zip(some, tokenizer.encode_batch_fast(["".join(x) for x in some], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.cumsum([len(u.encode()) for u in few])
            cuts = [0, *(np.searchsorted(np.cumsum(size[ids]), ends) + 1).tolist()]
            raw = ids.tobytes()
            found += [raw[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)]
        rest = iter(apart([u for u, x in zip(units, plain, strict=True) if not x]))
        found = iter(found)
        return [next(found) if x else next(rest) for x in plain]

    return encode


def pack(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", end: int = 1, window: int = WINDOW) -> DataFrame:
    """One row per piece: ``id``, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's ids are those that the byte-level ``tokenizers`` file ``path`` gives for the whole text, then ``end``. Documents longer than ``window`` fill whole
    windows first and only their rest is placed. At the end of a task what is left is poured together, so that each
    task leaves one partly filled window at most. Windows never span tasks: nothing is shuffled, and a lost task is
    packed again alone. ``sequence_id`` is unique over all tasks, not gapless.

    A null or empty text has the one id ``end``. Null ids of documents stay null, repeated rows are packed once each,
    an empty table has no rows. Other columns are dropped, whatever their names.
    """
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("hf")
        cache = kept(("hf", path), lambda: UnitCache(hf_encoder(path)))
        sequence = TaskContext.get().partitionId() << 40
        levels, stop = LevelArray(window), np.array([end], "<u4").tobytes()
        rows: list[tuple] = []

        def out(held: list) -> None:
            nonlocal sequence
            offset = 0
            for (doc, ids), start, length in held:
                rows.append((doc, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, sequence, offset))
                offset += length
            sequence += 1

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows.clear()
            return made

        types = None
        for batch in batches:
            types = types or [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            texts = (x.as_py() for x in batch.column(1))
            for doc, ids in zip(batch.column(0), cache.texts(texts), strict=True):
                whole = (doc.as_py(), ids + stop)
                n = len(whole[1]) // 4
                for start in range(0, n - window + 1, window):
                    out([(whole, start, window)])
                if rest := n % window:
                    held = levels.add((whole, n - rest, rest), rest)
                    if held:
                        out(held)
                if len(rows) > 500:
                    yield flush()
            batch = texts = None  # not while the next batch comes in
            release("hf")
        if types:
            for held in levels.pour():
                out(held)
            if rows:
                yield flush()

    names = [id, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    schema = f"`{id}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(id, text).mapInArrow(run, schema)
