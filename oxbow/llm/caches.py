"""What a Python worker remembers between tasks: the object of one operator at a time.

Workers are reused by later stages, so an operator's memory would else stay beside the next one's.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa

_held: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]) -> object:
    """The object of `key`, made if the worker doesn't hold it; whatever else it held goes."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    _held.clear()


def give_back() -> None:
    """Return what was freed to the system: allocators keep it else, and a worker's share grows from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """`run`, giving memory back when its partition is done."""

    @functools.wraps(run)
    def work(*args: object) -> Iterator:
        try:
            yield from run(*args)
        finally:
            give_back()

    return work
