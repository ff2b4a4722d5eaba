"""Special functions on numpy arrays that Spark has no built-in for."""

from __future__ import annotations

import math

import numpy as np

#: The first coefficients of Stirling's series for ln gamma.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def lgamma(x):
    """ln of gamma for positive values, by recurrence up to 8 and Stirling's series."""
    x = np.array(x, float)
    product = np.ones_like(x)
    for _ in range(8):
        low = x < 8
        product = product * np.where(low, x, 1)
        x = np.where(low, x + 1, x)
    f = 1 / (x * x)
    tail = np.zeros_like(x)
    for c in reversed(STIRLING):
        tail = tail * f + c
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + tail / x - np.log(product)


def erfc(x):
    """The complementary error function for values from 0 on: a series below 2, a continued fraction above."""
    x = np.array(x, float)
    low, high = np.minimum(x, 2), np.maximum(x, 2)
    term = total = 2 / math.sqrt(math.pi) * np.exp(-low * low) * low
    for n in range(1, 50):
        term = term * 2 * low * low / (2 * n + 1)
        total = total + term
    fraction = np.zeros_like(x)
    for n in range(100, 0, -1):
        fraction = n / 2 / (high + fraction)
    return np.where(x < 2, 1 - total, np.exp(-high * high) / math.sqrt(math.pi) / (high + fraction))


def digamma(x):
    """Psi by recurrence up to 6 and an asymptotic series."""
    x = np.array(x, float)
    total = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        total = total - np.where(low, 1 / np.where(low, x, 1), 0)
        x = np.where(low, x + 1, x)
    f = 1 / (x * x)
    return total + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def trigamma(x):
    x = np.array(x, float)
    total = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        total = total + np.where(low, 1 / np.where(low, x, 1) ** 2, 0)
        x = np.where(low, x + 1, x)
    f = 1 / (x * x)
    return total + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def inverse_digamma(y):
    """x with digamma(x) = y, by Newton steps from the usual start."""
    y = np.array(y, float)
    x = np.where(y >= -2.22, np.exp(np.minimum(y, 700)) + 0.5, -1 / (y + np.euler_gamma))
    for _ in range(40):
        x = np.maximum(x - (digamma(x) - y) / trigamma(x), 1e-300)
    return x


def chi2_upper(x, df):
    """P(X > x) of chi-square with whole degrees of freedom, element by element."""
    x, df = np.broadcast_arrays(np.maximum(np.array(x, float), 0), np.array(df, int))
    half = x / 2
    out = np.where(df % 2 == 1, erfc(np.sqrt(half)), 0.0)
    most = int(df.max()) if df.size else 0
    even = odd = None
    for k in range(0, most // 2 + 1):
        even = np.exp(-half) if k == 0 else even * half / k
        out = out + np.where((df % 2 == 0) & (k < df // 2), even, 0)
        if k >= 1:
            odd = np.exp(-half) * np.sqrt(half) / math.gamma(1.5) if k == 1 else odd * half / (k - 0.5)
            out = out + np.where((df % 2 == 1) & (k <= df // 2), odd, 0)
    return np.minimum(out, 1.0)


def log_sum_exp(x, axis=None):
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    return np.squeeze(top, axis) + np.log(np.sum(np.exp(x - top), axis=axis)) if axis is not None else float(top.ravel()[0] + np.log(np.exp(x - top).sum()))
