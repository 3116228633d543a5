"""Memory of Python workers: what one task has freed goes back before the next begins.

Workers outlive their tasks, and their allocators keep freed memory for reuse. The
workers of several stages would together hold the most that each has ever needed.
What an operator keeps in a worker from task to task is a named store(); a task of
any other operator empties it.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa

_stores: dict[str, dict] = {}

Run = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def store(name: str) -> dict:
    """This worker's own store of that name."""
    return _stores.setdefault(name, {})


def give_back(keep: str | None = None) -> None:
    """Empty all stores but the one to keep, and return freed memory to the system
    (a no-op where the C library can't)."""
    for name, held in _stores.items():
        if name != keep:
            held.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Run, keep: str | None = None) -> Run:
    """run, a function for mapInPandas, that takes over a worker without the stores of
    others and gives its memory back at its end, but for the store to keep."""

    @functools.wraps(run)
    def tidy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back(keep)
        try:
            yield from run(batches)
        finally:
            give_back(keep)

    return tidy
