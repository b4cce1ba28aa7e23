"""Column expressions Spark has no built-in for. All of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Coefficients of the published erf approximation 7.1.26 in
# Abramowitz and Stegun, Handbook of Mathematical Functions.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# Acklam's published rational approximation of the normal quantile.
PROBIT_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
            1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PROBIT_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
            6.680131188771972e01, -1.328068155288572e01)
PROBIT_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
            -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PROBIT_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
            3.754408661907416e00)
PROBIT_LOW = 0.02425


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_if_nan(x) -> Column:
    """NaN is the missing value at the border; inside Spark it is null."""
    x = c(x)
    return F.when(~F.isnan(x), x)


def null_if_not_finite(x) -> Column:
    x = c(x)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def safe_div(a, b) -> Column:
    """Division that yields null instead of an ANSI error on zero."""
    b = c(b)
    return c(a) / F.when(b != 0, b)


def _horner(coefs, x: Column) -> Column:
    return reduce(lambda acc, k: acc * x + F.lit(k), coefs[1:], F.lit(coefs[0]))


def erf(x) -> Column:
    """Error function, absolute error below 1.5e-7."""
    x = c(x).cast("double")
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * F.abs(x))
    y = F.lit(1.0) - _horner(ERF_A[::-1], t) * t * F.exp(-x * x)
    return F.when(x >= 0, y).otherwise(-y)


def probit(p, clip: float = 1e-7) -> Column:
    """Standard normal quantile; ends clipped (1e-7 gives about +-5.2)."""
    p = F.least(F.greatest(c(p).cast("double"), F.lit(clip)), F.lit(1.0 - clip))
    q = p - 0.5
    r = q * q
    mid = _horner(PROBIT_A, r) * q / (_horner(PROBIT_B, r) * r + 1.0)

    def tail(z: Column) -> Column:
        return _horner(PROBIT_C, z) / (_horner(PROBIT_D, z) * z + 1.0)

    low = tail(F.sqrt(-2.0 * F.ln(p)))
    high = -tail(F.sqrt(-2.0 * F.ln(1.0 - p)))
    return F.when(p < PROBIT_LOW, low).when(p > 1 - PROBIT_LOW, high).otherwise(mid)


def literal_map(mapping: dict) -> Column:
    """A small fixed dictionary as a map column."""
    return F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])


def lookup(mapping: dict, key) -> Column:
    """Value of a fixed dictionary for ``key``; null when absent (ANSI safe)."""
    return F.try_element_at(literal_map(mapping), c(key))


def str_array(values) -> Column:
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def psychometric_curve(x, bias, threshold, gamma1, gamma2) -> Column:
    """Two-lapse error-function psychometric curve."""
    g1, g2 = c(gamma1), c(gamma2)
    return g1 + (1 - g1 - g2) * (erf(safe_div(c(x) - c(bias), threshold)) + 1) / 2
