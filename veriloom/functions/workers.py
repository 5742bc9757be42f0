"""What a Python worker keeps between its tasks; imports nothing, so that it costs a worker nothing."""

from __future__ import annotations

from collections.abc import Callable

KEPT = 3
_MADE: dict[str, object] = {}


def made_once(key: str, make: Callable):
    """The object of ``key``, made by the first task of this worker that asks; the latest ``KEPT`` stay."""
    if key not in _MADE:
        for old in list(_MADE)[: len(_MADE) + 1 - KEPT]:
            del _MADE[old]
        _MADE[key] = make()
    return _MADE[key]
