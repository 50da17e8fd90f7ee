"""p-values that Spark has no function for, as Arrow-batched functions over small aggregates."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * beta_fraction(a, b, x) / a
    return 1.0 - front * beta_fraction(b, a, 1.0 - x) / b


def correlation_p(r: float, n: int) -> float | None:
    """Two-sided p of a correlation r over n points (Student's t with n - 2 degrees)."""
    if n < 3 or r is None or math.isnan(r):
        return None
    return beta_inc((n - 2) / 2.0, 0.5, max(0.0, 1.0 - r * r))


#: Values of U, n1 * n2 of them, up to which the exact distribution is written out: 64 MB.
EXACT_VALUES = 8_000_000


@lru_cache(4)
def rank_sum_counts(n1: int, n2: int) -> np.ndarray:
    """How many arrangements give each U, for sizes n1 and n2 without ties."""
    ways = np.zeros(n1 * n2 + 1)
    ways[0] = 1.0
    for k in range(1, n1 + 1):  # times (1 - q^(n2 + k)) / (1 - q^k)
        if n2 + k < len(ways):
            ways[n2 + k :] -= ways[: len(ways) - n2 - k].copy()
        for first in range(k):
            ways[first::k] = np.cumsum(ways[first::k])
    return ways


def mann_whitney_p(u1: float, n1: int, n2: int, ties: float) -> float | None:
    """Two-sided p of U1; ties is the sum of t^3 - t over groups of equal values.

    Exact if the smaller sample has at most 8 values, none tie and U has at most
    EXACT_VALUES values (the other sample a million or more), else the normal
    approximation with continuity and tie correction, which is as good there.
    """
    if not n1 or not n2:
        return None
    u = max(u1, n1 * n2 - u1)
    if min(n1, n2) <= 8 and not ties and n1 * n2 <= EXACT_VALUES:
        ways = rank_sum_counts(min(n1, n2), max(n1, n2))
        return min(1.0, float(2.0 * ways[math.ceil(u) :].sum() / ways.sum()))
    n = n1 + n2
    var = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    return min(1.0, math.erfc((u - n1 * n2 / 2.0 - 0.5) / math.sqrt(var) / math.sqrt(2.0)))


@F.pandas_udf(T.DoubleType())
def regression_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else correlation_p(a, int(b)) for a, b in zip(r, n)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def rank_test_p(u1: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([mann_whitney_p(u, int(a), int(b), t) for u, a, b, t in zip(u1, n1, n2, ties)], dtype="float64")
