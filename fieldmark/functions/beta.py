"""Quantiles of Beta distributions, for batches of rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

TINY = 1e-300


def _fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int = 300) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    away = lambda v: np.where(np.abs(v) < TINY, TINY, v)
    c, d = np.ones_like(x), 1 / away(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, steps):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for k in (even, odd):
            d, c = 1 / away(1 + k * d), away(1 + k / c)
            out *= c * d
        if np.all(np.abs(c * d - 1) < 1e-14):
            break
    return out


def below(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of Beta(a, b) below x."""
    log = np.vectorize(math.lgamma, otypes=[float])
    inner = np.clip(x, 1e-15, 1 - 1e-15)
    front = np.exp(log(a + b) - log(a) - log(b) + a * np.log(inner) + b * np.log1p(-inner))
    left = inner < (a + 1) / (a + b + 2)  # where the fraction converges fast; else by symmetry
    part = front * _fraction(np.where(left, inner, 1 - inner), np.where(left, a, b), np.where(left, b, a)) / np.where(left, a, b)
    return np.where(left, part, 1 - part)


@F.pandas_udf(DoubleType())
def beta_quantile(a: pd.Series, b: pd.Series, q: pd.Series) -> pd.Series:
    """x with a share q of Beta(a, b) below, by bisection; null where a or b is null or not positive."""
    good = (a > 0) & (b > 0) & q.notna()
    out = pd.Series(np.nan, index=a.index)
    if good.any():
        u, v, w = (s[good].to_numpy(float) for s in (a, b, q))
        low, high = np.zeros_like(u), np.ones_like(u)
        for _ in range(50):
            mid = (low + high) / 2
            under = below(mid, u, v) < w
            low, high = np.where(under, mid, low), np.where(under, high, mid)
        out[good] = (low + high) / 2
    return out
