"""Vector columns: stacking, norms and distances without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import col


def zero_if_missing(c) -> Column:
    return F.coalesce(F.nanvl(col(c).cast("double"), F.lit(0.0)), F.lit(0.0))


def stack(features: list[str]) -> Column:
    """Ordered feature columns as one vector, NaN and null -> 0."""
    return F.array(*[zero_if_missing(f) for f in features])


def norm(v) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalise(v, eps: float = 1e-12) -> Column:
    length = F.greatest(norm(v), F.lit(eps))
    return F.transform(col(v), lambda x: x / length)


def squared_distance(a, b) -> Column:
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x
    )


UNROLL_LIMIT = 16


def squared_distance_of(a: str, b: str, dims: int) -> Column:
    """Same value, for few dimensions as a flat sum that stays inside whole-stage codegen.

    Longer sums outgrow the size of a compiled method and would run interpreted.
    """
    if dims > UNROLL_LIMIT:
        return squared_distance(a, b)
    total = None
    for i in range(dims):
        d = F.element_at(a, i + 1) - F.element_at(b, i + 1)
        total = d * d if total is None else total + d * d
    return total


def add(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y)
