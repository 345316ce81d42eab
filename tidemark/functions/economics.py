"""Product economics: what an approved application earns or costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the product: yearly margin, amortisation factor, loss share.
ANNUAL_MARGIN = 0.12
AMORTISATION = 0.5
LOSS_GIVEN_DEFAULT = 0.55


def gain_if_paid(amount: Column, term_months: Column) -> Column:
    return amount * F.lit(ANNUAL_MARGIN) * (term_months / F.lit(12)) * F.lit(AMORTISATION)


def loss_if_default(amount: Column) -> Column:
    return amount * F.lit(LOSS_GIVEN_DEFAULT)


def break_even(gain: Column, loss: Column) -> Column:
    """Default probability at which approving earns nothing; null for a zero amount."""
    return F.try_divide(gain, gain + loss)


def approves(score: Column, threshold: Column) -> Column:
    """Strictly below the threshold; an unknown score or threshold is a rejection."""
    return F.coalesce(score < threshold, F.lit(False))


def realized(default: Column, gain: Column, loss: Column) -> Column:
    return F.when(default == 1, -loss).otherwise(gain)


def expected(score: Column, gain: Column, loss: Column) -> Column:
    return (F.lit(1) - score) * gain - score * loss
