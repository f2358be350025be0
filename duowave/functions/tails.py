"""Tail probabilities and quantiles of whole columns.

Spark has no Student t distribution, so these columns go through one Arrow-batched function. Every series, fraction and
root search advances all values of a batch together and lets go of those that have converged.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duowave.functions.gamma import log_rising

# Coefficients of Stirling's series, 1 / (2k (2k - 1)) times the Bernoulli numbers.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
# First parameter from which the expansion for large parameters is used, and its range of -log x.
_LARGE, _NEAR_ONE = 40.0, 0.5
_TINY = 1e-300


def _stirling_rest(x: np.ndarray) -> np.ndarray:
    """``lgamma(x)`` less its leading terms, for x of 10 or more."""
    return sum(c / x ** (2 * k + 1) for k, c in enumerate(_STIRLING))


def _log_gamma(b: np.ndarray) -> np.ndarray:
    return log_rising(np.ones_like(b), b) - np.log(b)


def _log_gamma_ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``lgamma(a + b) - lgamma(a)`` without the loss of digits of that difference at large ``a``."""
    high = np.maximum(a, 10.0)
    direct = _stirling_rest(high + b) - _stirling_rest(high) + (high + b - 0.5) * np.log1p(b / high) + b * np.log(high) - b
    return np.where(a < 10, log_rising(np.minimum(a, 10.0), b), direct)


def _log_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log of ``x``, by its complement ``y`` where ``x`` is near 1."""
    return np.where(y < 0.5, np.log1p(-np.minimum(y, 0.5)), np.log(x))


def _log_front(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log of ``x^a y^b / Beta(a, b)``."""
    small, large = np.minimum(a, b), np.maximum(a, b)
    return a * _log_of(x, y) + b * _log_of(y, x) + _log_gamma_ratio(large, small) - _log_gamma(small)


def _away(v: np.ndarray) -> np.ndarray:
    """Zeros replaced by a tiny number."""
    return np.where(np.abs(v) > _TINY, v, _TINY)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lower tail by the continued fraction, for x below its mean."""
    front = np.exp(_log_front(a, b, x, y)) / a
    found, at = np.empty_like(a), np.arange(len(a))
    last = 200 + 10 * np.sqrt(np.maximum(a, b))
    c, d = np.ones_like(a), 1 / _away(1 - (a + b) * x / (a + 1))
    h, k = d, 0
    while len(at):
        k += 1
        for step in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)),
                     -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d = 1 / _away(1 + step * d)
            c = _away(1 + step / c)
            change = c * d
            h = h * change
        open_ = ~(np.abs(change - 1) < 1e-15)
        if not open_.all():
            found[at[~open_]] = h[~open_]
            at, a, b, x, last, c, d, h = (v[open_] for v in (at, a, b, x, last, c, d, h))
        if (k > last).any():
            raise ArithmeticError(f"no convergence of the incomplete beta function at {a[0]}, {b[0]}, {x[0]}")
    return front * found


def _upper_series(b: np.ndarray, z: np.ndarray) -> np.ndarray:
    term = total = 1 / b
    n = 0
    while len(z) and (np.abs(term) > 1e-17 * np.abs(total)).any():
        n += 1
        term = term * z / (b + n)
        total = total + term
    with np.errstate(divide="ignore"):
        return 1 - np.exp(b * np.log(z) - z - _log_gamma(b)) * total


def _upper_fraction(b: np.ndarray, z: np.ndarray) -> np.ndarray:
    front = np.exp(b * np.log(z) - z - _log_gamma(b))
    found, at = np.empty_like(z), np.arange(len(z))
    c, d = np.full_like(z, 1e300), 1 / (z + 1 - b)
    h, k = d, 0
    while len(at):
        k += 1
        step = -k * (k - b)
        d = 1 / (step * d + z + 2 * k + 1 - b)
        c = z + 2 * k + 1 - b + step / c
        h = h * c * d
        open_ = ~(np.abs(c * d - 1) < 1e-15)
        if not open_.all():
            found[at[~open_]] = h[~open_]
            at, b, z, c, d, h = (v[open_] for v in (at, b, z, c, d, h))
        if k > 1000 and len(at):
            raise ArithmeticError(f"no convergence of the incomplete gamma function at {b[0]}, {z[0]}")
    return front * found


def _gamma_upper(b: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Upper regularised incomplete gamma function for ``b`` in (0, 1]."""
    found, low = np.empty_like(z), z < 1.5
    found[low] = _upper_series(b[low], z[low])
    found[~low] = _upper_fraction(b[~low], z[~low])
    return found


def erfc(x) -> np.ndarray:
    """Complementary error function of non-negative numbers."""
    z = np.atleast_1d(np.asarray(x, dtype=float)) ** 2
    # Beyond 745 nothing is left of exp(-z).
    return np.where(z > 745, 0.0, _gamma_upper(np.full_like(z, 0.5), np.minimum(z, 745.0))).reshape(np.shape(x))


def _large_first(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lower tail for large ``a`` and x near 1, by the expansion in incomplete gamma functions.

    Second parameters above 1 are first lowered by whole steps, whose terms are all positive.
    """
    steps = np.maximum(0, np.ceil(b) - 1)
    rest = b - steps
    added = np.zeros_like(a)
    at = np.flatnonzero(steps)
    term, k = np.exp(_log_front(a[at], rest[at], x[at], y[at])) / rest[at], 0
    while len(at):
        added[at] += term
        term = term * (a[at] + rest[at] + k) / (rest[at] + k + 1) * y[at]
        k += 1
        more = steps[at] > k
        at, term = at[more], term[more]
    log_x = np.log1p(-y)
    nu = a + (rest - 1) / 2
    at = np.flatnonzero(-nu * log_x <= 700)
    if not len(at):
        return added
    a, rest, nu, log_x = a[at], rest[at], nu[at], log_x[at]
    z = -nu * log_x
    scale = np.exp(_log_gamma_ratio(a, rest) - rest * np.log(nu))
    front = np.where(z > 0, np.exp(rest * np.log(np.maximum(z, _TINY)) - z - _log_gamma(rest)), 0.0)
    j = _gamma_upper(rest, z)
    total, p, half, power = j, [np.ones_like(a)], log_x / 2, 1.0
    for n in range(1, 60):
        # j is kept multiplied by the density, which would vanish on its own.
        j = ((rest + 2 * n - 2) * (rest + 2 * n - 1) * j + (z + rest + 2 * n - 1) * power * front) / (4 * nu * nu)
        power = power * half * half
        p.append((rest - 1) / math.factorial(2 * n + 1)
                 + sum((m * rest - n) * p[n - m] / math.factorial(2 * m + 1) for m in range(1, n)) / n)
        total = total + p[n] * j
        if (np.abs(p[n] * j) <= 1e-17 * np.abs(total)).all():
            added[at] += scale * total
            return added
    raise ArithmeticError(f"no convergence of the incomplete beta function at {a[0]}, {rest[0]}")


def _split(test: np.ndarray, yes, no, *parts: np.ndarray) -> np.ndarray:
    """``yes`` of the parts where the test holds and ``no`` of the others."""
    found = np.empty_like(parts[0])
    found[test] = yes(*(v[test] for v in parts))
    found[~test] = no(*(v[~test] for v in parts))
    return found


def _below_mean(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    expand = (b >= _LARGE) & (a <= np.maximum(1.0, b / 20)) & (-np.log1p(-x) < _NEAR_ONE)
    return _split(expand, lambda a, b, x, y: 1 - _large_first(b, a, y, x), _fraction, a, b, x, y)


def _either_side(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _split(x > (a + 1) / (a + b + 2), lambda a, b, x, y: 1 - _below_mean(b, a, y, x), _below_mean, a, b, x, y)


def _inside(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    # Beyond exp(-600) the fraction converges at once and keeps the last digits.
    depth = -_log_of(x, y)
    expand = (a >= _LARGE) & (b <= np.maximum(1.0, a / 20)) & (depth < _NEAR_ONE) & (a * depth < 600)
    return _split(expand, _large_first, _either_side, a, b, x, y)


def inc_beta(a, b, x, y=None) -> np.ndarray:
    """Regularised incomplete beta function; ``y`` is ``1 - x`` where that is known without loss of digits.

    A value that does not converge raises ``ArithmeticError``.
    """
    x = np.asarray(x, dtype=float)
    parts = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x, 1 - x if y is None else y)))
    flat = [np.ravel(p) for p in parts]
    found = np.where(flat[2] <= 0, 0.0, 1.0)
    found[np.isnan(flat).any(axis=0)] = math.nan
    inner = (flat[2] > 0) & (flat[3] > 0) & ~np.isnan(found)
    found[inner] = _inside(*(v[inner] for v in flat))
    return found.reshape(parts[0].shape)


def t_tail(t, df) -> np.ndarray:
    """Two-sided Student t probability."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return inc_beta(df / 2, 0.5, df / (df + t * t), t * t / (df + t * t))


def t_quantile(p: float, df) -> np.ndarray:
    """Student t quantile for ``p`` above one half.

    Newton steps from the normal quantile: the tail is convex and the start lies below, so they rise to the quantile and
    end where a step no longer rises.
    """
    dof, back = np.unique(np.ravel(np.asarray(df, dtype=float)), return_inverse=True)
    log_density = _log_gamma_ratio(dof / 2, np.full_like(dof, 0.5)) - 0.5 * np.log(dof * math.pi)
    t, at = np.full_like(dof, NormalDist().inv_cdf(p) * (1 - 1e-9)), np.arange(len(dof))
    while len(at):
        now, nu = t[at], dof[at]
        slope = 2 * np.exp(log_density[at] - (nu + 1) / 2 * np.log1p(now * now / nu))
        then = now + (t_tail(now, nu) - 2 * (1 - p)) / slope
        rises = then > now * (1 + 1e-15)
        at = at[rises]
        t[at] = then[rises]
    return t[back].reshape(np.shape(df))


def _nulled(values: np.ndarray, known: np.ndarray) -> pd.Series:
    return pd.Series(np.where(known, values, np.nan)).astype(object).where(known, None)


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    known = (t.notna() & df.notna() & (df > 0)).to_numpy()
    return _nulled(t_tail(np.where(known, t, 0.0), np.where(known, df, 1.0)), known)


@F.pandas_udf(T.DoubleType())
def f_upper(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    known = (f.notna() & df1.notna() & df2.notna() & (df2 > 0)).to_numpy()
    f, d1, d2 = (np.where(known, v.astype(float), 1.0) for v in (f, df1, df2))
    return _nulled(inc_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f)), known)


@F.pandas_udf(T.DoubleType())
def z_two_sided(z: pd.Series) -> pd.Series:
    known = z.notna().to_numpy()
    return _nulled(erfc(np.abs(np.where(known, z, 0.0).astype(float)) / math.sqrt(2)), known)


@F.pandas_udf(T.DoubleType())
def t_critical(df: pd.Series) -> pd.Series:
    """97.5 % point, the half width of a 95 % interval in standard errors."""
    known = (df.notna() & (df > 0)).to_numpy()
    return _nulled(t_quantile(0.975, np.where(known, df, 1.0)), known)


def with_t_inference(df: DataFrame, dof: Column | str = "dof") -> DataFrame:
    """Add statistic, p-value and 95 % limits to a table of ``estimate`` and ``std_error``."""
    dof = F.col(dof) if isinstance(dof, str) else dof
    dof = dof.cast("double")
    return (
        df.withColumn("statistic", F.try_divide("estimate", "std_error"))
        .withColumns({"p_value": t_two_sided("statistic", dof), "t_width": t_critical(dof)})
        .withColumns({
            "conf_low": F.col("estimate") - F.col("t_width") * F.col("std_error"),
            "conf_high": F.col("estimate") + F.col("t_width") * F.col("std_error"),
        })
        .drop("t_width")
    )
