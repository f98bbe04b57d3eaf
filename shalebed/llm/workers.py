"""What reused Python workers keep between tasks: caches of one operator at a time, and no freed memory."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache, wraps

import pyarrow as pa

_drops: dict[str, Callable[[], None]] = {}


@lru_cache(None)
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def give_back() -> None:
    """Hand freed memory to the operating system."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


@contextmanager
def caching(owner: str, drop: Callable[[], None] = lambda: None) -> Iterator[None]:
    """Around a task of ``owner``, whose caches ``drop`` empties: those of other operators go first."""
    for other in [o for o in _drops if o != owner]:
        _drops.pop(other)()
        gc.collect()
    _drops[owner] = drop
    try:
        yield
    finally:
        give_back()


def alone(owner: str) -> Callable:
    """Wraps a function over Arrow batches by :func:`caching`."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with caching(owner):
                yield from f(batches)

        return run

    return wrap
