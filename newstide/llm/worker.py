"""What a Python worker keeps between tasks. Spark reuses its workers, so a table or cache is built once for each."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable
from typing import Any

import pyarrow as pa


def _store() -> dict[tuple, Any]:
    return sys.__dict__.setdefault("_newstide_kept", {})


def kept(key: tuple, build: Callable[[], Any]) -> Any:
    """The value built for ``key`` by the first task of this worker that asked for it."""
    store = _store()
    if key not in store:
        store[key] = build()
    return store[key]


def release(*kinds: str) -> None:
    """Drop what other operators have kept (keys that begin otherwise) and give freed memory back to the system.

    Workers go from one operator to the next, and those of an executor share its memory: without this each holds the
    tables of every operator it has run, and the largest heap any of them needed.
    """
    store = _store()
    for key in [k for k in store if k[0] not in kinds]:
        del store[key]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
