"""Standard normal distribution as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Published double-precision rational approximation of the normal integral (Hart / West).
NUMERATOR = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
DENOMINATOR = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948,
               440.413735824752]


def _poly(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / 2.5066282746310002


def cdf(x: Column) -> Column:
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    inner = e * _poly(a, NUMERATOR) / _poly(a, DENOMINATOR)
    outer = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, inner).otherwise(outer)
    return F.when(x > 0, 1 - tail).otherwise(tail)
