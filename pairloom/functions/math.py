"""Normal-distribution expressions from built-in functions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points of the quadrature; the error of erf is below 1e-12 everywhere.
POINTS = 20


def erf_expr(x: Column) -> Column:
    """erf(x) = 2 x / sqrt(pi) * integral over u of exp(-(x u)^2), by Gauss-Legendre; +-1 beyond 6.

    Only arithmetic and exp, so that it stays in generated code.
    """
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    total = F.lit(0.0)
    for u, w in zip((nodes + 1) / 2, weights / 2):
        total = total + F.lit(float(w)) * F.exp(F.lit(float(-u * u)) * x * x)
    return F.when(F.abs(x) >= 6, F.signum(x)).otherwise(F.lit(2.0 / math.sqrt(math.pi)) * x * total)


def normal_cdf(x: Column) -> Column:
    """Phi(x)."""
    return F.lit(0.5) * (F.lit(1.0) + erf_expr(x / F.lit(math.sqrt(2.0))))


def correlation(x: str, y: str) -> Column:
    """Pearson's, of two columns of a group without nulls; null where one has no spread, where ``corr`` fails under ANSI."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
