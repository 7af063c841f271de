"""What reused Python workers hold: vocabularies and models of a stage are let go when another stage's function starts in the worker."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_caches: list[Callable] = []


def held(cached: Callable) -> Callable:
    """Register a function with an ``lru_cache``."""
    _caches.append(cached)
    return cached


def only(*kept: Callable) -> None:
    """Empty all registered caches but these, and give what was freed back to the system."""
    for cached in _caches:
        if not any(cached is k for k in kept):
            cached.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
