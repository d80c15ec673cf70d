"""Named-job registry (X1): register a job function by name, look it up."""

from __future__ import annotations

from collections.abc import Callable

_JOBS: dict[str, Callable] = {}


def register(name: str, fn: Callable | None = None):
    """Register ``fn`` under ``name``; usable as ``@register("name")``."""
    def deco(f):
        _JOBS[name] = f
        return f
    return deco(fn) if fn is not None else deco


def get(name: str) -> Callable:
    """The job registered as ``name``; unknown names raise with the known list."""
    try:
        return _JOBS[name]
    except KeyError:
        raise KeyError(f"unknown job {name!r}; known jobs: {sorted(_JOBS)}") from None


def names() -> list[str]:
    return sorted(_JOBS)
