"""What Python worker processes keep from one task to the next: caches by name, and no other memory."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa


def worker_state(key: tuple, make: Callable):
    """The value made for ``key`` in this process; made anew where the worker is new."""
    kept = sys.modules.setdefault("logfold_worker_state", types.ModuleType("logfold_worker_state")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """An Arrow pass that hands its freed memory back to the system at the end of the task.

    Workers live on for later stages; what their allocators hold back adds up over the stages of a pipeline.
    """
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
                ctypes.CDLL(None).malloc_trim(0)

    return whole
