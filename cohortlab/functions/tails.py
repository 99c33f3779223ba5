"""Distribution tails for summary rows.

Inputs are one row per feature, pair or model, never the measurements, so these
vectorised functions see small batches. The incomplete gamma and beta functions
use the textbook series and continued fractions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

_EPS = 1e-16
_TINY = 1e-300


def _ibeta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _ibeta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), _TINY)
    frac = d
    for m in range(1, 2000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for term in (even, odd):
            d = 1.0 / ((1.0 + term * d) or _TINY)
            c = (1.0 + term / c) or _TINY
            step = d * c
            frac *= step
        if abs(step - 1.0) < _EPS * 10:
            break
    return front * frac / a


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while term > total * _EPS:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - front * total
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    frac = d
    for i in range(1, 5000):
        term = -i * (i - a)
        b += 2.0
        d = 1.0 / ((term * d + b) or _TINY)
        c = (b + term / c) or _TINY
        frac *= d * c
        if abs(d * c - 1.0) < _EPS * 10:
            break
    return front * frac


def norm_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def t_two_sided(t: float, df: float) -> float:
    return _ibeta(df / 2.0, 0.5, df / (df + t * t))


def chi2_upper(x: float, df: float) -> float:
    return _upper_gamma(df / 2.0, x / 2.0)


def f_upper(x: float, d1: float, d2: float) -> float:
    return _ibeta(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * x))


def _log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeom_upper(k: float, total: float, marked: float, drawn: float) -> float:
    """P(X >= k) when ``drawn`` items leave a pool of ``total`` with ``marked`` marked."""
    low, high = int(max(0, drawn + marked - total)), int(min(marked, drawn))
    start = max(int(k), low)
    if start > high:
        return 0.0
    mode = min(max(int((marked + 1) * (drawn + 1) / (total + 2)), low), high)
    if start > mode:
        return min(1.0, _tail(start, high, total, marked, drawn))
    return min(1.0, _tail(mode, high, total, marked, drawn) + (_tail(mode - 1, start, total, marked, drawn) if start < mode else 0.0))


def _log_mass(i: float, total: float, marked: float, drawn: float) -> float:
    return _log_choose(marked, i) + _log_choose(total - marked, drawn - i) - _log_choose(total, drawn)


def _tail(start: int, stop: int, total: float, marked: float, drawn: float) -> float:
    """Mass from ``start`` through ``stop``, away from the mode, by the ratio of neighbours; ends when terms no longer count."""
    term = math.exp(_log_mass(start, total, marked, drawn))
    terms, reached, i = [term], term, start
    while i != stop and term > reached * 1e-18:
        if stop > start:
            term *= (marked - i) * (drawn - i) / ((i + 1.0) * (total - marked - drawn + i + 1.0))
            i += 1
        else:
            term *= i * (total - marked - drawn + i) / ((marked - i + 1.0) * (drawn - i + 1.0))
            i -= 1
        terms.append(term)
        reached += term
    return math.fsum(terms)


def fisher_two_sided(a: float, b: float, c: float, d: float) -> float:
    """Sum of table probabilities not above the observed one (relative slack 1e-7)."""
    total, marked, drawn = a + b + c + d, a + b, a + c
    low, high = int(max(0, drawn + marked - total)), int(min(marked, drawn))
    mode = min(max(int((marked + 1) * (drawn + 1) / (total + 2)), low), high)
    limit = _log_mass(a, total, marked, drawn) + math.log1p(1e-7)
    over = lambda i: _log_mass(i, total, marked, drawn) > limit
    if not over(mode):
        return 1.0
    # either side of the mode falls away from it: halve the distance to the first table that counts
    left, right = low - 1, mode
    while right - left > 1:
        middle = (left + right) // 2
        left, right = (left, middle) if over(middle) else (middle, right)
    below = left
    left, right = mode, high + 1
    while right - left > 1:
        middle = (left + right) // 2
        left, right = (middle, right) if over(middle) else (left, middle)
    mass = (_tail(below, low, total, marked, drawn) if below >= low else 0.0) + (_tail(right, high, total, marked, drawn) if right <= high else 0.0)
    return min(1.0, mass)


def trigamma_inverse(y: float) -> float:
    """x with trigamma(x) = y, by Newton steps on 1/trigamma."""

    def poly(x: float, order: int) -> float:
        total = 0.0
        while x < 15.0:
            total += 1.0 / x**2 if order == 1 else -2.0 / x**3
            x += 1.0
        if order == 1:
            return total + 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5) + 1 / (42 * x**7)
        return total - 1 / x**2 - 1 / x**3 - 1 / (2 * x**4) + 1 / (6 * x**6) - 1 / (6 * x**8)

    if y > 1e7:
        return 1.0 / math.sqrt(y)
    if y < 1e-6:
        return 1.0 / y
    x = 0.5 + 1.0 / y
    for _ in range(60):
        value = poly(x, 1)
        step = value * (1 - value / y) / poly(x, 2)
        x += step
        if abs(step / x) < 1e-12:
            break
    return x


def digamma(x: float) -> float:
    total = 0.0
    while x < 30.0:
        total -= 1.0 / x
        x += 1.0
    return total + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def rank_sum_two_sided(ranks: np.ndarray, n1: int, observed: int) -> float:
    """Share of the splits of whole-number ``ranks`` into n1 and the rest whose sum is at least as far from its mean as ``observed``.

    Cases are drawn rank by rank; the table holds the chance of each (cases so far, sum so far).
    """
    n, top = len(ranks), int(ranks.sum())
    if 2 * n1 > n:
        n1, observed = n - n1, top - observed
    ranks = np.sort(ranks)
    width = int(ranks[n - n1 :].sum()) + 1
    chance = np.zeros((n1 + 1, width))
    chance[0, 0] = 1.0
    left = n1 - np.arange(n1 + 1)
    for j, rank in enumerate(ranks):
        taken = chance * (left / (n - j))[:, None]
        chance -= taken
        chance[1:, rank:] += taken[:-1, : width - rank]
    far = np.abs(np.arange(width) * n - n1 * top) >= abs(observed * n - n1 * top)
    return float(min(1.0, chance[n1][far].sum()))


def _column(fn):
    """Vectorised Spark function over scalar tails; null or NaN in, null out."""

    @F.pandas_udf(T.DoubleType())
    def apply(*cols: pd.Series) -> pd.Series:
        table = np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in cols])
        keep = np.isfinite(table).all(axis=1)
        out = np.full(len(table), np.nan)
        out[keep] = [fn(*row) for row in table[keep]]
        return pd.Series(out).astype("Float64").mask(~keep)

    return lambda *cols: apply(*[F.col(c) if isinstance(c, str) else c for c in cols])


norm_p = _column(norm_two_sided)
t_p = _column(t_two_sided)
chi2_p = _column(chi2_upper)
f_p = _column(f_upper)
hypergeom_p = _column(hypergeom_upper)
fisher_p = _column(fisher_two_sided)
trigamma_inv = _column(trigamma_inverse)
digamma_col = _column(digamma)


@F.pandas_udf(T.DoubleType())
def rank_sum_p(ranks: pd.Series, n1: pd.Series, observed: pd.Series) -> pd.Series:
    return pd.Series([rank_sum_two_sided(np.asarray(r, dtype=np.int64), int(n), int(s)) for r, n, s in zip(ranks, n1, observed, strict=True)], dtype=float)
