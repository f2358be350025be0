"""Gamma-function helpers over arrays, and the normal quantile as a column.

Differences are computed as such, which keeps their digits where the two terms are large and close.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Bernoulli numbers B2, B4, ... of the asymptotic series.
BERNOULLI = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730)
# Arguments are raised by this much before a series is used.
SHIFT = 10


def _raised(a: np.ndarray, y: np.ndarray, term) -> np.ndarray:
    """Sum over the first ``SHIFT`` steps of ``term(a + j) - term(a + y + j)``."""
    return sum(term(a + j) - term(a + y + j) for j in range(SHIFT))


def log_rising(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``log Gamma(a + y) - log Gamma(a)`` for positive ``a`` and non-negative ``y``, which need not be whole."""
    low = np.asarray(a, dtype=float) + SHIFT
    high = low + y
    rest = sum(b / (2 * k * (2 * k - 1)) * (high ** (1 - 2 * k) - low ** (1 - 2 * k)) for k, b in enumerate(BERNOULLI, 1))
    series = (high - 0.5) * np.log1p(y / low) + y * np.log(low) - y + rest
    return series + _raised(a, y, np.log)


def digamma_rising(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """First derivative of ``log_rising`` in ``a``."""
    low = np.asarray(a, dtype=float) + SHIFT
    high = low + y
    rest = sum(b / (2 * k) * (high ** (-2 * k) - low ** (-2 * k)) for k, b in enumerate(BERNOULLI, 1))
    return np.log1p(y / low) - 0.5 / high + 0.5 / low - rest + _raised(a, y, lambda x: 1 / x)


def trigamma_rising(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivative of ``log_rising`` in ``a``."""
    low = np.asarray(a, dtype=float) + SHIFT
    high = low + y

    def series(x: np.ndarray) -> np.ndarray:
        return 1 / x + 0.5 / x**2 + sum(b * x ** (-2 * k - 1) for k, b in enumerate(BERNOULLI, 1))

    return series(high) - series(low) - _raised(a, y, lambda x: 1 / x**2)


# Rational approximations of the normal quantile to 16 digits (algorithm AS 241), numerators and
# denominators by rising powers, for the middle, the near tail and the far tail.
_MIDDLE = ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
            4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
           (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
            2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3))
_NEAR = ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
          1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
         (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
          1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
_FAR = ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
         2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
        (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
         7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))


def polynomial(coefficients: Sequence[float], x: Column) -> Column:
    """Polynomial by rising powers."""
    return reduce(lambda value, c: value * x + F.lit(c), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile of probabilities between 0 and 1, computed inside the JVM."""
    q = p - 0.5
    tail = F.sqrt(-F.log(F.least(p, 1 - p)))

    def ratio(table, x: Column) -> Column:
        return polynomial(table[0], x) / polynomial(table[1], x)

    outer = F.signum(q) * F.when(tail <= 5.0, ratio(_NEAR, tail - 1.6)).otherwise(ratio(_FAR, tail - 5.0))
    return F.when(F.abs(q) <= 0.425, q * ratio(_MIDDLE, F.lit(0.180625) - q * q)).otherwise(outer)
