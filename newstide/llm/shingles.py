"""Word shingles of many texts as sets of 64-bit numbers, computed in numpy over whole batches of bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from newstide.llm.worker import kept

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2 ** 64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * GOLDEN)
BYTE[ord("A") : ord("Z") + 1] = BYTE[ord("a") : ord("z") + 1]  # A-Z count as a-z
KEPT_POWERS = 1 << 21  # chunks of texts end a little above 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of ``BASE`` and of its inverse, at least; a worker keeps the tables for texts of common length only."""
    size = max(KEPT_POWERS, n)

    def build() -> tuple[np.ndarray, np.ndarray]:
        def powers(base: int) -> np.ndarray:
            out = np.ones(size, np.uint64)
            done = 1
            while done < size:
                out[done : 2 * done] = out[: min(done, size - done)] * np.uint64(pow(base, done, 1 << 64))
                done *= 2
            return out

        return powers(BASE), powers(pow(BASE, -1, 1 << 64))

    return kept(("powers", size), build) if size == KEPT_POWERS else build()


def shingle_sets(texts: Sequence[str | None], width: int = 5, chunk: int = 1 << 20) -> Iterator[np.ndarray]:
    """Per text the sorted distinct shingles of ``width`` words.

    Words are runs of other characters than ASCII white space, A-Z count as a-z. A text of fewer words has its whole
    sequence as one shingle, a text without words or a null has none.
    """
    some: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        some.append(raw)
        size += len(raw) + 1
        if size >= chunk:
            yield from _sets(some, width)
            some, size = [], 0
    if some:
        yield from _sets(some, width)


def _sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(space & ~np.concatenate([[True], space[:-1]]))
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * power[: len(data)], out=total[1:])
    words = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * GOLDEN)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(starts, text_ends)  # by text, the number of words up to its end
    grams = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        grams = (grams + words[k : k + len(grams)]) * GOLDEN
    grams = mix(grams)
    first = 0
    for end in last.tolist():
        n = end - first
        if n >= width:
            yield np.unique(grams[first : end - width + 1])
        elif n:
            h = np.array([n], np.uint64)
            for w in words[first:end]:
                h = (h + w) * GOLDEN
            yield mix(h ^ np.uint64(0x5851F42D4C957F2D))
        else:
            yield np.zeros(0, np.uint64)
        first = end


def fingerprint(items: np.ndarray) -> bytes:
    """Sixteen bytes that stand for a whole set: two sums of differently mixed items, with the size."""
    a, b = mix(items + GOLDEN), mix(items ^ np.uint64(0xA0761D6478BD642F))
    n = np.array([len(items)], np.uint64)
    return np.concatenate([mix(a.sum(dtype=np.uint64)[None] + n), mix(b.sum(dtype=np.uint64)[None] ^ n * GOLDEN)]).astype("<u8").tobytes()
