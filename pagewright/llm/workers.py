"""Memory of Python workers, which Spark reuses for later tasks and stages."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool and the C library otherwise keep it for this process."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` that gives memory back when its task ends.

    Without it a worker that once held a large task (a tokenizer's words, say) takes as much beside the JVM in
    every later stage that uses it.
    """

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
