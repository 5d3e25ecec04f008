"""Exact (Clopper-Pearson) binomial interval on small binned tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, modified Lentz method."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_cdf(a, b, x) -> np.ndarray:
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    low = inner < (a + 1) / (a + b + 2)
    p, q = np.where(low, a, b), np.where(low, b, a)
    y = np.where(low, inner, 1 - inner)
    part = front * _beta_fraction(p, q, y) / p
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(low, part, 1 - part)))


def beta_quantile(probability, a, b) -> np.ndarray:
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    lo, hi = np.zeros_like(a), np.ones_like(a)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = beta_cdf(a, b, mid) < probability
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def clopper_pearson(passed, total, level: float = 0.68) -> tuple[np.ndarray, np.ndarray]:
    """Distances from passed/total to the lower and upper bound; NaN where total is 0."""
    k, n = np.asarray(passed, dtype=float), np.asarray(total, dtype=float)
    alpha = (1 - level) / 2
    safe_k = np.clip(k, 1, None)
    lo = np.where(k > 0, beta_quantile(alpha, safe_k, np.clip(n - k, 0, None) + 1), 0.0)
    hi = np.where(k < n, beta_quantile(1 - alpha, k + 1, np.clip(n - k, 1, None)), 1.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(n > 0, k / n, np.nan)
    return mean - lo, hi - mean


def interval_udf(level: float = 0.68):
    """Arrow UDF (passed, total) -> struct(err_low, err_high)."""

    @F.pandas_udf("err_low double, err_high double")
    def interval(passed: pd.Series, total: pd.Series) -> pd.DataFrame:
        low, high = clopper_pearson(passed.to_numpy(), total.to_numpy(), level)
        return pd.DataFrame({"err_low": low, "err_high": high})

    return interval
