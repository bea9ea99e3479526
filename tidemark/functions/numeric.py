"""Numeric expressions that are safe under ANSI mode."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: coefficients of Lanczos' approximation of the gamma function for g = 7
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
            -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6,
            1.5056327351493116e-7)
_FRACTION_STEPS = 2_000    # the fraction converges in about the root of its larger parameter
_TINY = 1e-300


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def softmax(logits: list[Column]) -> list[Column]:
    """Softmax over a fixed set of columns, shifted by the maximum so that it cannot overflow."""
    top = F.greatest(*logits)
    powers = [F.exp(x - top) for x in logits]
    total = powers[0]
    for p in powers[1:]:
        total = total + p
    return [p / total for p in powers]


def _ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 0.5."""
    z = x - 1.0
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + c / (z + float(i))
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.ln(t) - t + F.ln(total)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    def safe(v):
        return F.when(F.abs(v) < _TINY, _TINY).otherwise(v)

    d = 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))

    def half(acc, term):
        d = 1.0 / safe(1.0 + term * acc["d"])
        c = safe(1.0 + term / acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))

    def even(acc, m):
        return half(acc, m * (b - m) * x / ((a - 1.0 + 2.0 * m) * (a + 2.0 * m)))

    def odd(acc, m):
        return half(acc, -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 1.0 + 2.0 * m)))

    steps = F.transform(F.sequence(F.lit(2), F.lit(2 * _FRACTION_STEPS + 1)),
                        lambda k: F.struct(F.floor(k / 2).cast("double").alias("m"),
                                           (k % 2 == 0).alias("even")))
    return F.aggregate(steps, start,
                       lambda acc, k: F.when(k["even"], even(acc, k["m"]))
                       .otherwise(odd(acc, k["m"])), lambda acc: acc["h"])


def _beta_share(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """Regularised incomplete beta function at x = 1 - ``rest``, both in (0, 1)."""
    front = F.exp(_ln_gamma(a + b) - _ln_gamma(a) - _ln_gamma(b) + a * F.ln(x) + b * F.ln(rest))
    return F.when(x < (a + 1.0) / (a + b + 2.0), front * _beta_fraction(a, b, x) / a).otherwise(
        1.0 - front * _beta_fraction(b, a, rest) / b)


def correlation_p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation ``r`` of ``n`` pairs under t with n - 2 freedom.

    It is the regularised incomplete beta function of 1 - r^2 for (n - 2) / 2 and 1 / 2.
    """
    square = r * r
    half = F.greatest((n - 2).cast("double") / 2.0, F.lit(0.5))
    p = (F.when(F.abs(r) >= 1.0, 0.0).when(square < _TINY, 1.0)
         .otherwise(_beta_share(half, F.lit(0.5), 1.0 - square, square)))
    return F.when(r.isNotNull() & (n > 2), F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0)))
