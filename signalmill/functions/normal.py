"""Normal distribution as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Abramowitz & Stegun 26.2.17.
CDF_P = 0.2316419
CDF_SCALE = 0.3989422804014327
CDF_B = (0.31938153, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
# Acklam's inverse normal approximation.
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
QUANTILE_TAIL = 0.02425


def _poly(x: Column, coefs) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf(x: Column) -> Column:
    t = 1 / (1 + F.lit(CDF_P) * F.abs(x))
    tail = F.lit(CDF_SCALE) * F.exp(-(x * x) / 2) * t * _poly(t, CDF_B[::-1])
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution for 0 < p < 1, NULL outside."""
    tail = lambda q: _poly(q, QUANTILE_C) / (_poly(q, QUANTILE_D) * q + 1)
    low = tail(F.sqrt(-2 * F.log(p)))
    high = -tail(F.sqrt(-2 * F.log(1 - p)))
    q = p - 0.5
    r = q * q
    mid = _poly(r, QUANTILE_A) * q / (_poly(r, QUANTILE_B) * r + 1)
    inside = F.when(p < QUANTILE_TAIL, low).when(p > 1 - QUANTILE_TAIL, high).otherwise(mid)
    return F.when((p > 0) & (p < 1), inside)
