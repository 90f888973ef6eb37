"""Tail probabilities for test statistics, applied to result tables of a few rows."""

from __future__ import annotations

import math

import pandas as pd
from statloom.functions.vectors import vector_udf


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a+1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_lower(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x, df):
    return None if pd.isna(x) or pd.isna(df) or df <= 0 else _gamma_upper(df / 2.0, x / 2.0)


def t_two_sided(t, df):
    return None if pd.isna(t) or pd.isna(df) or df <= 0 else _beta_lower(df / 2.0, 0.5, df / (df + t * t))


def f_sf(f, d1, d2):
    if pd.isna(f) or pd.isna(d1) or pd.isna(d2) or d1 <= 0 or d2 <= 0:
        return None
    return _beta_lower(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * max(f, 0.0)))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile of Student's t by bisection on the tail."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        if 1 - t_two_sided(mid, df) / 2 < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def _series(fn, *args):
    return pd.Series([fn(*row) for row in zip(*args)], dtype="float64")


@vector_udf("double")
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _series(chi2_sf, x, df)


@vector_udf("double")
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _series(t_two_sided, t, df)


@vector_udf("double")
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _series(f_sf, f, d1, d2)


@vector_udf("double")
def z_p(z: pd.Series) -> pd.Series:
    return _series(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2)), z)
