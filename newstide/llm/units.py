"""Token ids of many texts through a cache of their units.

A unit is a stretch of text that starts at a single space between two other characters. Byte-level BPE splitters never
join characters over such a place, so the ids of a text are the ids of its units, one after the other. Texts repeat
their units, which makes one dictionary look-up of most of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

GAP = re.compile(r"(?<=\S) (?=\S)")
FIRST, LAST = " <", " >"  # mark the first unit of a text, which has no space before it, and a last one that may end with white space


class UnitCache:
    """Little-endian unsigned 32-bit ids by unit, for at most ``limit`` units of at most ``longest`` characters."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 500_000, longest: int = 48):
        self.encode, self.limit, self.longest = encode, limit, longest
        self.ids: dict[str, bytes] = {}

    def texts(self, texts: Iterable[str | None], chunk: int = 1 << 20) -> Iterator[bytes]:
        """The ids of each text in order; a null counts as empty. About ``chunk`` characters are worked on at once."""
        some, size = [], 0
        for text in texts:
            some.append(text or "")
            size += len(some[-1])
            if size >= chunk:
                yield from self._chunk(some)
                some, size = [], 0
        if some:
            yield from self._chunk(some)

    def _chunk(self, texts: Sequence[str]) -> list[bytes]:
        cut = [_spaced(t) for t in texts]
        got = [list(map(self.ids.get, u)) for u in cut]
        new = _missing(cut, got)
        odd = {u for u in new if not u or u[-1].isspace() or (u[0].isspace() and not u.startswith(FIRST))}
        if odd:
            for k, u in enumerate(cut):
                if not odd.isdisjoint(u):
                    cut[k] = _careful(texts[k])
                    got[k] = list(map(self.ids.get, cut[k]))
            new = _missing(cut, got)
        if new:
            names = list(new)
            ids = dict(zip(names, self.encode([_text(u) for u in names]), strict=True))
            for units, found in zip(cut, got, strict=True):
                at = -1
                for _ in range(found.count(None)):
                    at = found.index(None, at + 1)
                    found[at] = ids[units[at]]
            if len(self.ids) < self.limit:
                self.ids.update(x for x in ids.items() if len(x[0]) <= self.longest)
        return [b"".join(x) for x in got]


def _missing(cut: list[list[str]], got: list[list[bytes | None]]) -> set[str]:
    return {u for units, found in zip(cut, got, strict=True) if None in found for u, x in zip(units, found, strict=True) if x is None}


def _spaced(text: str) -> list[str]:
    units = text.split(" ")
    units[0] = FIRST + units[0]
    return units


def _careful(text: str) -> list[str]:
    """As ``_spaced`` for a text that has white space next to a space, or at an end."""
    units = GAP.split(text)
    if len(units) > 1:
        units[-1] = LAST + units[-1]
    units[0] = FIRST + units[0]
    return units


def _text(unit: str) -> str:
    return unit[2:] if unit.startswith(FIRST) else " " + unit[2:] if unit.startswith(LAST) else " " + unit
