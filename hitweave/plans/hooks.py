"""User functions by name: graph builders, track builders, readers and event processing.

A hook takes and returns DataFrames over all events, so user code is planned with
the rest instead of being called once per event.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

KINDS = ("reader", "graph", "track", "processing")
_HOOKS: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str) -> Callable[[Callable], Callable]:
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}, expected one of {KINDS}")

    def keep(fn: Callable) -> Callable:
        _HOOKS[(kind, name)] = fn
        return fn

    return keep


def get(kind: str, name: str) -> Callable:
    if (kind, name) not in _HOOKS:
        known = sorted(n for k, n in _HOOKS if k == kind)
        raise KeyError(f"no {kind} called {name}; known: {known}")
    return _HOOKS[(kind, name)]


def process(
    names: list[str], hits: DataFrame, particles: DataFrame, tracks: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run processing hooks in order on (hits, particles, tracks)."""
    for name in names:
        hits, particles, tracks = get("processing", name)(hits, particles, tracks)
    return hits, particles, tracks
