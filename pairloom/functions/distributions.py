"""Tail probabilities as vectorised column functions: normal, chi squared, t and binomial."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1.0 - total * scale
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_lower(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_upper(t: float, df: float) -> float:
    tail = 0.5 * beta_lower(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def binomial_both(k: float, n: float) -> float | None:
    """Two-sided exact p value of k of n fair trials; none without trials."""
    if n < 1:
        return None
    k = min(k, n - k)
    return min(1.0, 2.0 * sum(math.comb(int(n), i) for i in range(int(k) + 1)) / 2.0 ** int(n))


def signed_rank_both(w: float, n: float) -> float:
    """Two-sided exact p value of a signed-rank sum ``w`` of ``n`` differences, by counting the subsets of 1 .. n by sum."""
    ways = np.ones(1)
    for k in range(1, int(n) + 1):
        ways = np.concatenate([ways, np.zeros(k)]) + np.concatenate([np.zeros(k), ways])
    at = int(round(w))
    return float(min(1.0, 2.0 * min(ways[: at + 1].sum(), ways[at:].sum()) / 2.0 ** int(n)))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """Standard normal quantile by Newton's steps on the distribution function."""
    x = 0.0
    for _ in range(60):
        x -= max(-1.0, min(1.0, (normal_cdf(x) - p) / (math.exp(-x * x / 2) / math.sqrt(2 * math.pi))))
    return x


def nemenyi_quantile(k: float, level: float) -> float:
    """Upper quantile of the range of ``k`` standard normal variables, over the root of 2."""
    z = np.linspace(-9.0, 9.0, 1801)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    below = np.array([normal_cdf(v) for v in z])
    step = z[1] - z[0]

    def upper(q: float) -> float:
        shifted = np.array([normal_cdf(v - q) for v in z])
        return 1.0 - float(k * (density * (below - shifted) ** (k - 1)).sum() * step)  # smooth and 0 at the ends: exact to 1e-12

    low, high = 0.0, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if upper(mid) > level else (low, mid)
    return low / math.sqrt(2)


def sign_test_power(share: float, level: float, n: float) -> float:
    """Power of the exact one-sided sign test of ``n`` trials that succeed with probability ``share``."""
    n = int(n)
    upper = lambda p: np.cumsum([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n, -1, -1)])[::-1]
    critical = np.flatnonzero(upper(0.5) <= level)
    return float(upper(share)[critical[0]]) if len(critical) else 0.0


def _column(f, *cols) -> Column:
    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        out = [None if any(pd.isna(x) for x in row) else f(*map(float, row)) for row in zip(*series)]
        return pd.Series(np.array([np.nan if v is None else v for v in out], float)).astype(object).where(lambda s: s.notna(), None).astype("Float64")

    return run(*[F.col(c) if isinstance(c, str) else c for c in cols])


def normal_two_sided(z) -> Column:
    return _column(lambda v: math.erfc(abs(v) / math.sqrt(2)), z)


def chi2_sf(x, df) -> Column:
    return _column(lambda v, k: gamma_upper(k / 2, v / 2), x, df)


def t_sf(t, df) -> Column:
    return _column(t_upper, t, df)


def binomial_two_sided(k, n) -> Column:
    return _column(binomial_both, k, n)


def signed_rank_two_sided(w, n) -> Column:
    return _column(signed_rank_both, w, n)


def nemenyi_q(k, level) -> Column:
    return _column(nemenyi_quantile, k, level)


def normal_below(z) -> Column:
    return _column(normal_cdf, z)


def sign_power(share, level, n) -> Column:
    return _column(sign_test_power, share, level, n)
