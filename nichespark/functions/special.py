"""Vectorised special functions in numpy for the dense kernels (no scipy here)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_LANCZOS = (676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)  # fixed values
_N = NormalDist()
_erfc = np.vectorize(math.erfc, otypes=[float])


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0."""
    x = np.asarray(x, float)
    small = x < 0.5
    z = np.where(small, 1 - x, x) - 1
    a = np.full(z.shape, 0.99999999999980993)
    for i, c in enumerate(_LANCZOS):
        a = a + c / (z + i + 1)
    t = z + 7.5
    out = 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(t) - t + np.log(a)
    return np.where(small, np.log(np.pi / np.abs(np.sin(np.pi * np.where(small, x, 0.25)))) - out, out)


def pnorm(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(-np.asarray(z, float) / math.sqrt(2))


def qnorm(p: np.ndarray) -> np.ndarray:
    flat = np.asarray(p, float)
    return np.array([_N.inv_cdf(x) if 0 < x < 1 else math.copysign(math.inf, x - 0.5) for x in flat.ravel()]).reshape(flat.shape)


def betainc(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (Lentz)."""
    x = np.clip(np.asarray(x, float), 0, 1)
    a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    y = np.clip(y, 1e-300, 1 - 1e-16)
    front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    c, d = np.ones_like(y), 1 / np.where(np.abs(1 - (p + q) * y / (p + 1)) < 1e-300, 1e-300, 1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    out = front * h
    out = np.where(flip, 1 - out, out)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def pt(t: np.ndarray, df, lower: bool = True) -> np.ndarray:
    """Tail of Student's t (df None: normal; else scalar or one per column)."""
    t = np.asarray(t, float)
    if df is None:
        return pnorm(t if lower else -t)
    df = np.asarray(df, float)
    half = 0.5 * betainc(df / 2, 0.5, df / (df + t * t))
    return np.where((t < 0) if lower else (t > 0), half, 1 - half)


def gammaincc(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma."""
    a, x = (np.array(v, float) for v in np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float)))
    y = np.maximum(x, 1e-300)
    front = np.exp(-y + a * np.log(y) - lgamma(a))
    term, total = 1 / a, 1 / a
    for n in range(1, 3000):
        term = term * y / (a + n)
        total = total + term
        if np.all((term < total * 1e-16) | (x >= a + 1)):
            break
    series = 1 - front * total
    b = y + 1 - a
    c, d = np.full_like(y, 1e300), 1 / np.where(np.abs(b) < 1e-300, 1e-300, b)
    h = d.copy()
    for n in range(1, 3000):
        k = -n * (n - a)
        b = b + 2
        d = k * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + k / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * d * c
        if np.all((np.abs(d * c - 1) < 1e-15) | (x < a + 1)):
            break
    return np.where(x <= 0, 1.0, np.where(x < a + 1, series, front * h))


def pchisq_upper(x: np.ndarray, df) -> np.ndarray:
    return gammaincc(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def nb_loglik(y: np.ndarray, mu: np.ndarray, psi: np.ndarray) -> np.ndarray:
    """log of the negative binomial mass at y with mean mu and size 1/psi."""
    r = 1 / psi
    return lgamma(y + r) - lgamma(r) - lgamma(y + 1.0) + r * np.log(r / (r + mu)) + y * np.log(np.maximum(mu, 1e-300) / (r + mu))
