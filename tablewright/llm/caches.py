"""Small memories of a Python worker."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable
from types import ModuleType

import pyarrow as pa


class Recent(dict):
    """Results of ``make`` for recent keys: between ``limit`` and twice as many are held, whatever number comes by."""

    def __init__(self, make: Callable, limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def kept(name: str, make: Callable):
    """What ``make`` returned when a task first asked for ``name`` in this worker; later tasks get it again."""
    holder = sys.modules.setdefault("_tablewright_kept", ModuleType("_tablewright_kept"))
    if not hasattr(holder, name):
        give_back()
        setattr(holder, name, make())
    return getattr(holder, name)


def forget() -> None:
    """Lets go of what other work has kept in this worker: a worker outlives the stage that filled its memory."""
    sys.modules.pop("_tablewright_kept", None)


def give_back() -> None:
    """Returns memory that nothing uses any more to the system: Arrow's, and the C library's where it can be asked to."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
