"""Memory of Python workers, which outlive their tasks and would hold on to what an operator is done with."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def released(*caches: dict) -> None:
    """Empty the caches and hand free memory back to the system, at the end of a task."""
    for cache in caches:
        cache.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
