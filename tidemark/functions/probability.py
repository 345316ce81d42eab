"""Probability corrections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def prior_correction(score: Column, true_rate, trained_rate) -> Column:
    """Bring a score learned at ``trained_rate`` back to ``true_rate``.

    The odds are multiplied by the ratio of the two prior odds: monotone in the
    score, and the identity when the rates agree.
    """
    pi, pt = _column(true_rate), _column(trained_rate)
    positive = score * pi * (F.lit(1.0) - pt)
    total = positive + (F.lit(1.0) - score) * pt * (F.lit(1.0) - pi)
    return positive / F.when(total <= 0, F.lit(1e-12)).otherwise(total)


def hard_predict(score: Column, cut: float = 0.5) -> Column:
    return (score >= F.lit(cut)).cast("int")
