"""One table of remembered results a Python worker.

Workers outlive tasks and stages. A memo kept for good by each operator would add
up over a pipeline, so a worker holds one: asking for another drops the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import TypeVar

import pyarrow as pa

Made = TypeVar("Made")
_held: dict[Hashable, object] = {}


def only(name: Hashable, make: Callable[[], Made]) -> Made:
    """What ``make`` gives, made anew unless it was the last thing asked for."""
    if name not in _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        _held[name] = make()
    return _held[name]
