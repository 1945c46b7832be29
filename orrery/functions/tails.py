"""Tail probabilities of the normal, chi-squared and t distributions, for vectors and as Arrow-backed column functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

TINY, STEPS = 1e-300, 500


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def norm_logsf(z: float) -> float:
    """log of the upper tail; beyond z = 30, where the tail leaves the range of doubles' precision, by its asymptotic series."""
    if z < 30:
        return math.log(norm_sf(z))
    s = 1 / (z * z)
    return -z * z / 2 - math.log(z * math.sqrt(2 * math.pi)) + math.log1p(-s * (1 - 3 * s * (1 - 5 * s)))


def _continued(terms, start: float) -> float:
    """Value of start + a1 / (b1 + a2 / (b2 + ...)), by Lentz's method."""
    f = start or TINY
    c, d = f, 0.0
    for a, b in terms:
        d = b + a * d or TINY
        c = b + a / c or TINY
        d = 1 / d
        f *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return f


def log_gamma_q(a: float, x: float) -> float:
    """log of the regularised upper incomplete gamma function."""
    if x <= 0:
        return 0.0
    scale = -x + a * math.log(x) - math.lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 10_000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-17:
                break
        lower = math.exp(scale) * total
        return math.log1p(-lower) if lower < 1 else -math.inf
    f = _continued(((-n * (n - a), x + 2 * n + 1 - a) for n in range(1, 10_000)), x + 1 - a)
    return scale - math.log(f)


def chi2_sf(x: float, df: float) -> float:
    return math.exp(log_gamma_q(df / 2, x / 2))


def chi2_logsf(x: float, df: float) -> float:
    return log_gamma_q(df / 2, x / 2)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a

    def terms():
        yield 1.0, 1.0
        for i in range(1, STEPS):
            m = i // 2
            top = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            yield top, 1.0

    return front * _continued(terms(), TINY)


def t_sf(t: float, df: float) -> float:
    half = 0.5 * beta_i(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def t_ppf(p: float, df: float) -> float:
    """Quantile, by bisection on the tail."""
    if p < 0.5:
        return -t_ppf(1 - p, df)
    low, high = 0.0, 1.0
    while t_sf(high, df) > 1 - p:
        low, high = high, 2 * high
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_sf(mid, df) > 1 - p else (low, mid)
    return (low + high) / 2


def mann_whitney_exact_sf(u: float, n1: int, n2: int) -> float:
    """P(U >= u) without ties, by counting the orders of both samples with each U, from the nearer end of its range.

    Steps grow with the smaller sample times n1 * n2, all within numpy.
    """
    few, many = sorted((n1, n2))
    least = math.ceil(u)
    if least <= 0 or least > few * many:
        return float(least <= 0)
    if 2 * least <= few * many:
        return 1 - mann_whitney_exact_sf(few * many - least + 1, n1, n2)
    counts = np.zeros(few * many - least + 1, np.longdouble)  # of U as far below its largest value
    counts[0] = 1
    for i in range(1, few + 1):  # Gaussian binomial coefficient: multiply by (1 - q^(many + i)) / (1 - q^i)
        counts[many + i :] -= counts[: max(0, len(counts) - many - i)].copy()
        padded = np.pad(counts, (0, -len(counts) % i)).reshape(-1, i)
        counts = padded.cumsum(axis=0).reshape(-1)[: len(counts)]
    return float(counts.sum() / np.longdouble(math.comb(few + many, few)))


def mann_whitney_p(u: float, n1: int, n2: int, ties: float, greater: bool = False) -> float:
    """p of U of the first sample: exact if the smaller sample has 8 values at most and none are tied, else normal with
    tie and continuity correction."""
    top = u if greater else max(u, n1 * n2 - u)
    if min(n1, n2) <= 8 and ties == 0:
        p = mann_whitney_exact_sf(top, n1, n2)
    else:
        n = n1 + n2
        spread = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
        p = norm_sf((top - n1 * n2 / 2 - 0.5) / spread) if spread > 0 else 1.0
    return min(1.0, p if greater else 2 * p)


def _mapped(f):
    """A function of numbers as one of columns; null where an argument is null."""

    @pandas_udf("double")
    def column(*values: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(x) for x in row) else f(*map(float, row)) for row in zip(*values)], dtype="float64")

    return column


def normal_sf(z: Column) -> Column:
    return _mapped(norm_sf)(z)


def two_sided_normal(z: Column) -> Column:
    return _mapped(lambda z: 2 * norm_sf(abs(z)))(z)


def two_sided_normal_log(z: Column) -> Column:
    return _mapped(lambda z: norm_logsf(abs(z)) + math.log(2))(z)


def chi_squared_sf(x: Column, df: Column) -> Column:
    return _mapped(chi2_sf)(x, df)


def chi_squared_logsf(x: Column, df: Column) -> Column:
    return _mapped(chi2_logsf)(x, df)


def two_sided_t(t: Column, df: Column) -> Column:
    return _mapped(lambda t, df: 2 * t_sf(abs(t), df))(t, df)


def t_quantile(p: float, df: Column) -> Column:
    return _mapped(lambda df: t_ppf(p, df))(df)


def mann_whitney_two_sided(u: Column, n1: Column, n2: Column, ties: Column) -> Column:
    return _mapped(lambda u, a, b, t: mann_whitney_p(u, int(a), int(b), t))(u, n1, n2, ties)
