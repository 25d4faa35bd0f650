"""Distribution functions in numpy, for tasks that fit models."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def normal_cdf(x):
    return 0.5 * _erfc(-np.asarray(x, float) / math.sqrt(2))


def bisect(f, low: np.ndarray, high: np.ndarray, steps: int = 80) -> np.ndarray:
    """Roots of an increasing function, one for each pair of bounds."""
    low, high = np.array(low, float), np.array(high, float)
    for _ in range(steps):
        mid = (low + high) / 2
        below = f(mid) < 0
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def beta_inc(a, b, x, terms: int = 300):
    """Regularised incomplete beta function by its continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, terms):
        for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) + _lgamma(p + q) - _lgamma(p) - _lgamma(q)) / p
    value = np.where(y <= 0, 0.0, front * h)
    return np.where(swap, 1 - value, value)


def t_cdf(x, df):
    x, df = np.broadcast_arrays(np.asarray(x, float), np.asarray(df, float))
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + x * x))
    return np.where(x > 0, 1 - tail, tail)


def t_ppf(p, df):
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    return bisect(lambda x: t_cdf(x, df) - p, np.full(p.shape, -1e3), np.full(p.shape, 1e3), 100)


def gamma_inc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        total = term = 1 / a
        for k in range(1, 1000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-16:
                break
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for k in range(1, 1000):
        step = -k * (k - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_inc_upper(df / 2, x / 2)


def binomial_test(k: int, n: int) -> float:
    """Two-sided exact p-value of k successes of n at one half."""
    if n == 0:
        return float("nan")
    i = np.arange(n + 1)
    log_p = math.lgamma(n + 1) - _lgamma(i + 1) - _lgamma(n - i + 1) - n * math.log(2)
    p = np.exp(log_p)
    return float(min(1.0, p[p <= p[k] * (1 + 1e-9)].sum()))
