"""Upper-tail probabilities of test statistics.

They apply to result tables of a few rows, after the distributed sums.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chi2_tail(x: float, dof: float) -> float:
    """P(chi-square > x), by series or continued fraction of the incomplete gamma."""
    if x is None or dof is None or math.isnan(x) or dof <= 0:
        return math.nan
    a, z = dof / 2, x / 2
    if z <= 0:
        return 1.0
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - total * scale)
    # evaluated from far inside outwards; 500 levels are ample past z > a
    fraction = 0.0
    for i in range(500, 0, -1):
        fraction = i * (i - a) / (z + 2 * i + 1 - a - fraction)
    return scale / (z + 1 - a - fraction)


def f_tail(x: float, d1: float, d2: float) -> float:
    """P(F > x), by the continued fraction of the incomplete beta."""
    if x is None or math.isnan(x) or d1 <= 0 or d2 <= 0:
        return math.nan
    if x <= 0:
        return 1.0
    a, b, t = d2 / 2, d1 / 2, d2 / (d2 + d1 * x)
    if t > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - t)
    return _beta(a, b, t)


def _beta(a: float, b: float, t: float) -> float:
    if t <= 0:
        return 0.0
    fraction = 1.0
    for m in range(300, 0, -1):
        even = m * (b - m) * t / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * t / ((a + 2 * m - 2) * (a + 2 * m - 1))
        fraction = 1 + odd / (1 + even / fraction)
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(t) + b * math.log1p(-t)
    return math.exp(front) / (a * fraction)


@F.pandas_udf(T.DoubleType())
def chi2_p_value(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(*pair) for pair in zip(x, dof)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def f_p_value(x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_tail(*triple) for triple in zip(x, d1, d2)], dtype="float64")
