"""Tails of ``special`` in numpy, a batch of rows at a time, for tables with many: the same formulas, whose loops end where all rows are done."""

from __future__ import annotations

from math import log, pi

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from editloom.functions.special import LANCZOS


def lgamma(x: np.ndarray) -> np.ndarray:
    z = x - 1
    total = LANCZOS[0] + sum(c / (z + i) for i, c in enumerate(LANCZOS[1:], 1))
    t = z + 7.5
    return 0.5 * log(2 * pi) + (z + 0.5) * np.log(t) - t + np.log(total)


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 60) -> np.ndarray:
    """Regularised incomplete beta for a, b > 0, by its continued fraction on the side where it converges."""
    out = np.where(x >= 1, 1.0, np.where(x <= 0, 0.0, np.nan))
    inner = np.flatnonzero((x > 0) & (x < 1))
    a, b, x = a[inner], b[inner], x[inner]
    direct = x < (a + 1) / (a + b + 2)
    p, q, y = np.where(direct, a, b), np.where(direct, b, a), np.where(direct, x, 1 - x)
    c, d, h = np.ones(len(y)), np.zeros(len(y)), np.ones(len(y))
    for j in range(1, 2 * steps + 1):
        top = -(p + (j - 1) / 2) * (p + q + (j - 1) / 2) if j % 2 else (j / 2) * (q - j / 2)
        term = top * y / ((p + j - 1) * (p + j))
        c, d = 1 + term / c, 1 / (1 + term * d)
        h *= c * d
        if j % 8 == 0 and (np.abs(c * d - 1) < 1e-16).all():
            break
    part = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / h / p
    out[inner] = np.where(direct, part, 1 - part)
    return out


def binom_sf(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.where(k <= 0, 1.0, 0.0)
    inner = np.flatnonzero((k > 0) & (k <= n))
    out[inner] = betainc(k[inner], n[inner] - k[inner] + 1, p[inner])
    return out


def f_upper(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    out = np.full(len(f), np.nan)
    some = np.flatnonzero((d1 > 0) & (d2 > 0) & ~np.isnan(f))
    f, d1, d2 = f[some], d1[some], d2[some]
    out[some] = betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))
    return out


def excess(k: np.ndarray, t_p: np.ndarray, c_p: np.ndarray, n: np.ndarray, most: int = 400, least: float = 1e-6) -> np.ndarray:
    k, n = np.floor(k), np.floor(n)
    x = np.minimum(k, n)
    pmf = np.exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * np.log(t_p) + (n - x) * np.log1p(-t_p))
    control, at, tail, total = np.exp(n * np.log1p(-c_p)), np.where(k > n, 0.0, pmf), binom_sf(k, n, t_p), np.zeros(len(k))
    left = np.arange(len(k))
    for i in range(most + 1):
        term = control * tail
        total[left] += term
        go = np.flatnonzero(~(term <= least))
        if not len(go):
            break
        left, k, n, t_p, c_p, control, at, tail = (v[go] for v in (left, k, n, t_p, c_p, control, at, tail))
        control = control * (n - i) / (i + 1) * c_p / (1 - c_p)
        after = at * np.maximum(n - k - i, 0.0) / (k + i + 1) * t_p / (1 - t_p)
        tail, at = np.maximum(tail - at, 0.0), after
    return total


@F.pandas_udf(DoubleType())
def _f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_upper(*(c.to_numpy(float) for c in (f, d1, d2))))


@F.pandas_udf(DoubleType())
def _excess(k: pd.Series, t_p: pd.Series, c_p: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(excess(*(c.to_numpy(float) for c in (k, t_p, c_p, n))))


def f_sf(f: Column, d1: Column, d2: Column) -> Column:
    """``special.f_sf``."""
    return _f_sf(f.cast("double"), d1.cast("double"), d2.cast("double"))


def binom_minus_binom(k: Column, t_p: Column, c_p: Column, n: Column) -> Column:
    """``special.binom_minus_binom`` at its defaults."""
    return _excess(*(c.cast("double") for c in (k, t_p, c_p, n)))
