"""Selections written as plain dictionaries, turned into boolean columns.

Two dialects exist and differ on purpose:

* :func:`condition` -- a bool or other scalar means equality, ``[lo, hi]`` a closed
  range, ``["in"|"not_in"|"is"|"is_not"|"within"|"not_within", value]`` the named test;
* :func:`fiducial` -- a scalar means "at least", ``[lo, hi]`` a closed range and
  ``["not_in", values]`` an exclusion that a missing value passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import col


def _range(c: Column, low, high) -> Column:
    # NaN sorts above every number in Spark, but compares false in the data model.
    number = c.cast("double")
    return ~F.isnan(number) & number.between(F.lit(float(low)), F.lit(float(high)))


def condition(column, spec) -> Column:
    c = col(column)
    if isinstance(spec, bool):
        test = c.cast("boolean") == F.lit(spec)
    elif isinstance(spec, (list, tuple)) and isinstance(spec[0], str):
        kind, value = spec
        tests = {
            "is": lambda: c == F.lit(value),
            "is_not": lambda: c != F.lit(value),
            "in": lambda: c.isin(list(value)),
            "not_in": lambda: ~c.isin(list(value)),
            "within": lambda: _range(c, *value),
            "not_within": lambda: ~_range(c, *value),
        }
        if kind not in tests:
            raise ValueError(f"unknown test {kind!r} on {column}")
        test = tests[kind]()
    elif isinstance(spec, (list, tuple)):
        test = _range(c, *spec)
    else:
        raise ValueError(f"condition {spec!r} on {column} is not understood")
    return F.coalesce(test, F.lit(False))


def all_of(conditions: dict) -> Column:
    """AND of conditions over the columns they name."""
    return reduce(lambda a, b: a & b, (condition(k, v) for k, v in conditions.items()), F.lit(True))


def fiducial(selection: dict) -> Column:
    tests = [F.lit(True)]
    for name, spec in selection.items():
        c = F.col(name)
        if isinstance(spec, (list, tuple)) and spec[0] == "not_in":
            tests.append(F.coalesce(~c.isin(list(spec[1])), F.lit(True)))
        elif isinstance(spec, (list, tuple)):
            tests.append(F.coalesce(_range(c, *spec), F.lit(False)))
        else:
            tests.append(F.coalesce(~F.isnan(c.cast("double")) & (c >= F.lit(spec)), F.lit(False)))
    return reduce(lambda a, b: a & b, tests)
