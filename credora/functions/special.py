"""Tail probabilities for test statistics, as vectorised pandas UDFs.

They run on the one-row-per-column result tables of the tests, so the statistic
never leaves Spark; the maths is the textbook series / continued fraction.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_sf(z: float) -> float:
    """P(Z > z) for a standard normal."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _terms(a: float) -> int:
    """Terms that suffice: both expansions need a multiple of sqrt(a) of them near x = a."""
    return 10_000 + int(50 * math.sqrt(a))


def _gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    if x < a + 1.0:  # series for P, then Q = 1 - P
        term = 1.0 / a
        total = term
        ap = a
        for _ in range(_terms(a)):
            ap += 1.0
            term *= x / ap
            total += term
            if abs(term) < abs(total) * 1e-16:
                break
        else:
            raise ArithmeticError(f"tail series did not converge for a={a}, x={x}")
        return max(0.0, 1.0 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    # Lentz continued fraction for Q
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, _terms(a)):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 4e-16:
            break
    else:
        raise ArithmeticError(f"tail fraction did not converge for a={a}, x={x}")
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(x: float, dof: float) -> float:
    """P(X > x) for a chi-square with ``dof`` degrees of freedom."""
    if x is None or dof is None or dof <= 0:
        return float("nan")
    return _gamma_q(dof / 2.0, x / 2.0)


@F.pandas_udf(T.DoubleType())
def normal_two_sided_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: float("nan") if pd.isna(v) else min(1.0, 2.0 * normal_sf(abs(v))))


@F.pandas_udf(T.DoubleType())
def chi2_p(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([float("nan") if pd.isna(s) or pd.isna(d) else chi2_sf(float(s), float(d))
                      for s, d in zip(stat, dof)])
