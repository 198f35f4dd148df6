"""Column-level statistics helpers (R3, M1, M4/M5, W7), as built-in expressions.

The p-value of a Pearson r over n points is the regularised incomplete beta function
I_x(a, 1/2) with a = (n - 2) / 2, x = 1 - r^2.  It is computed from the upper tail, so small values
keep their relative precision, and in constant work whatever n is.  With y = r^2:

* y >= 1/2: x^a y^(1/2) / (a B) F(a + 1/2, 1; a + 1; x), a series of positive terms whose ratios
  are below x <= 1/2;
* y < 1/2 and a y >= 3: x^a y^(-1/2) / (a B) F(1/2, 1; a + 1; -x/y), whose continued fraction has
  positive terms only and converges the faster the larger a y is;
* else 1 - 2 y^(1/2) x^a / B F(a + 1/2, 1; 3/2; y), a series of positive terms, where the
  p-value is not small.

Here B = B(a, 1/2), and 1 / B comes from an asymptotic series of gamma ratios, shifted by
``SHIFT`` so that it is exact to double precision from a = 1/2 on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col):
    return F.col(col) if isinstance(col, str) else col


#: Most terms of the series (ratios end below 1/2) and of the continued fraction (fewer are taken where these
#: converge sooner), and factors of the gamma ratio.
SERIES, FRACTION, SHIFT = 62, 56, 8
#: Coefficients of 1/b, 1/b^3, ... of log Gamma(b + 1/2) - log Gamma(b) - log(b) / 2.
GAMMA = (-1 / 8, 1 / 192, -1 / 640, 17 / 14336, -31 / 18432, 691 / 180224)


def _steps(upper: Column, most: int, step) -> Column:
    """1.0 after ``step`` has been applied for k = upper .. 1, at most ``most`` times."""
    first = F.least(F.ceil(upper), F.lit(most)).cast("int")
    return F.aggregate(F.sequence(F.greatest(first, F.lit(1)), F.lit(1), F.lit(-1)), F.lit(1.0), step)


def _gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a)."""
    b = a + F.lit(float(SHIFT))
    i = F.lit(1.0) / b
    log = F.lit(0.0)
    for c in reversed(GAMMA):
        log = F.lit(c) + i * i * log
    ratio = F.sqrt(b) * F.exp(i * log)
    for j in range(SHIFT):
        ratio = ratio * (a + float(j)) / (a + (j + 0.5))
    return ratio


def _series(top: Column, bottom: Column, z: Column, terms: Column) -> Column:
    """F(top, 1; bottom; z) = 1 + top/bottom z (1 + (top + 1)/(bottom + 1) z (...))."""
    return _steps(terms, SERIES, lambda acc, k: F.lit(1.0) + (top + k - 1.0) / (bottom + k - 1.0) * z * acc)


def _fraction(a: Column, w: Column, terms: Column) -> Column:
    """F(1/2, 1; a + 1; -w) = 1/(1 + c1 w/(1 + c2 w/(1 + ...)))."""
    def step(acc, k):
        c = (k / 2.0) * (a + (k - 1.0) / 2.0) / ((a + k - 1.0) * (a + k))
        return F.lit(1.0) / (F.lit(1.0) + c * w * acc)

    return _steps(terms, FRACTION, step)


def corr_p_value(r: Column | str, n: Column | str) -> Column:
    """Two-sided p-value of a Pearson correlation r over n points (null below 3 points)."""
    r, n = _c(r), _c(n).cast("long")
    size = F.least(F.abs(r), F.lit(1.0))
    a = (n - 2) / F.lit(2.0)
    y, x = size * size, (F.lit(1.0) - size) * (F.lit(1.0) + size)
    log_x = F.when(y < 0.5, F.log1p(-y)).otherwise(F.log(x))
    scale = F.exp(a * log_x) * _gamma_ratio(a) / F.lit(math.sqrt(math.pi))  # x^a / B
    p = (F.when(x == 0, F.lit(0.0)).when(y == 0, F.lit(1.0))
         .when(y >= 0.5, scale / a * size * _series(a + 0.5, a + 1.0, x, -50.0 / F.log2(x)))
         .when(a * y >= 3, scale / a / size * _fraction(a, x / y, 8.0 + 160.0 / (a * y)))
         .otherwise(F.lit(1.0) - F.lit(2.0) * size * scale * _series(a + 0.5, F.lit(1.5), y, 10.0 + 6.0 * a * y - 44.0 / F.log2(y))))
    return F.when(r.isNull() | (n < 3), F.lit(None).cast("double")).otherwise(
        F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def chi2_tail(statistic: Column | str, freedom: Column | str, most: int) -> Column:
    """Upper tail of the chi-squared distribution with ``freedom`` degrees (1 to ``most``, else null): the
    regularised incomplete gamma function Q(a, x) with a = freedom / 2, x = statistic / 2, from a series of positive
    terms of the lower part where x < a + 1, else from the upper part's continued fraction, so that
    small values keep their relative precision."""
    freedom = _c(freedom).cast("int")
    known = (freedom >= 1) & (freedom <= most)
    a, x = freedom / F.lit(2.0), _c(statistic) / F.lit(2.0)
    logs = F.array(*[F.lit(math.lgamma(d / 2)) for d in range(1, most + 1)])
    scale = F.exp(a * F.log(x) - x - F.get(logs, freedom - 1))  # x^a e^-x / Gamma(a)
    lower = scale / a * _steps(F.lit(SERIES), SERIES, lambda acc, k: F.lit(1.0) + x / (a + k) * acc)
    rest = _steps(F.lit(FRACTION), FRACTION, lambda acc, k: k * (a - k) / (x + k * F.lit(2.0) + 1.0 - a + acc))
    tail = F.when(x <= 0, F.lit(1.0)).when(x < a + 1.0, F.lit(1.0) - lower).otherwise(scale / (x + 1.0 - a + rest))
    return F.when(known & x.isNotNull(), F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))


def argmax_first(scores: Column | str) -> Column:
    """0-based index of the maximum, first index on ties."""
    s = _c(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")
