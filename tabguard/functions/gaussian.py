"""Standard normal quantile function as a Column (rational approximation by P. J. Acklam)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published coefficients of the approximation (relative error below 1.2e-9).
CENTRE_NUMERATOR = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
CENTRE_DENOMINATOR = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01, 1.0,
)
TAIL_NUMERATOR = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
TAIL_DENOMINATOR = (
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
    3.754408661907416e00, 1.0,
)
TAIL_BOUND = 0.02425


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    value = F.lit(coefficients[0])
    for coefficient in coefficients[1:]:
        value = value * x + F.lit(coefficient)
    return value


def inverse_normal(p: Column) -> Column:
    """z with P(Z <= z) = p for 0 < p < 1; null outside."""
    lower = F.least(p, F.lit(1.0) - p)
    q = F.sqrt(F.lit(-2.0) * F.log(lower))
    tail = _horner(TAIL_NUMERATOR, q) / _horner(TAIL_DENOMINATOR, q)
    centred = p - F.lit(0.5)
    r = centred * centred
    centre = _horner(CENTRE_NUMERATOR, r) * centred / _horner(CENTRE_DENOMINATOR, r)
    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < F.lit(TAIL_BOUND), tail)
        .when(p > F.lit(1.0 - TAIL_BOUND), -tail)
        .otherwise(centre)
    )
