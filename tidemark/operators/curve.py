"""Cumulative class counts by score, the table behind ranking metrics.

A window over all scores would put every row in one task. Rows are first
summed per distinct score, so a score shared by a third of the rows is one
row. Running totals are then built in two levels: inside narrow bands of the
[0, 1] scale, and over the bands. The band is a function of the score alone,
which keeps the result exact and independent of partitioning. Distinct scores
within a millionth of each other, or outside the scale, share one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import SCORE, TARGET

BANDS = 1 << 20


def score_counts(scored: DataFrame, score: str = SCORE, target: str | None = TARGET,
                 by=()) -> DataFrame:
    """``pos`` and ``neg`` rows per distinct score; a missing score is an error.

    Without a target all rows count as ``neg``.
    """
    value = F.nanvl(F.col(score), F.lit(None).cast("double"))
    # the last literal is never reached; it makes the column non-nullable, so no
    # null filter sets the branches of score_curve apart and they share one shuffle
    known = F.coalesce(value, F.raise_error(F.lit("missing score")).cast("double"), F.lit(0.0))
    is_bad = (F.col(target) == 1) if target else F.lit(False)
    return scored.groupBy(*by, known.alias("score")).agg(
        F.count_if(is_bad).alias("pos"), F.count_if(~is_bad).alias("neg"))


def _band(score: Column) -> Column:
    unit = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    # floor is declared nullable; see score_counts on why the band must not be
    return F.coalesce(F.floor(unit * F.lit(float(BANDS))).cast("int"), F.lit(0))


def score_curve(counts: DataFrame, by=()) -> DataFrame:
    """Add ``cum_pos``, ``cum_neg`` (rows scored at or above) and the totals.

    ``by`` names the score sets when several share the table; their number is
    the caller's (models, rounds), not the data's.
    """
    by = list(by)
    band = by + ["band"]
    tagged = counts.withColumn("band", _band(F.col("score")))

    def running(column, partition, order):
        return F.sum(column).over(Window.partitionBy(*partition).orderBy(F.desc(order)))

    inside = tagged.select(
        *band, "score", "pos", "neg",
        running("pos", band, "score").alias("cum_pos"),
        running("neg", band, "score").alias("cum_neg"))
    # at most BANDS + 1 rows per score set, however many scores there are
    bands = tagged.groupBy(*band).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    whole = Window.partitionBy(*by)
    above = bands.select(
        *band,
        (running("pos", by, "band") - F.col("pos")).alias("above_pos"),
        (running("neg", by, "band") - F.col("neg")).alias("above_neg"),
        F.sum("pos").over(whole).alias("total_pos"),
        F.sum("neg").over(whole).alias("total_neg"))
    return (
        inside.join(above, band)
        .select(
            *by, "score", "pos", "neg",
            (F.col("cum_pos") + F.col("above_pos")).alias("cum_pos"),
            (F.col("cum_neg") + F.col("above_neg")).alias("cum_neg"),
            "total_pos", "total_neg")
    )


def interpolate(low: Column, high: Column, fraction: Column) -> Column:
    """Linear interpolation, taken from the nearer end."""
    width = high - low
    return F.when(fraction >= 0.5, high - width * (F.lit(1.0) - fraction)) \
            .otherwise(low + width * fraction)


def score_quantiles(curve: DataFrame, probabilities, by=()) -> DataFrame:
    """Exact interpolated quantiles of the scores, as an array ``q``."""
    total = F.col("total_pos") + F.col("total_neg")
    through = total - (F.col("cum_pos") + F.col("cum_neg")) + F.col("pos") + F.col("neg")
    before = through - F.col("pos") - F.col("neg")

    def at_rank(rank):
        return F.max(F.when((before <= rank) & (rank < through), F.col("score")))

    ends = []
    for p in probabilities:
        position = F.lit(float(p)) * (total - 1)
        low = F.floor(position)
        ends.append(F.struct(
            at_rank(low).alias("low"),
            at_rank(F.least(low + 1, total - 1)).alias("high"),
            F.max(position - low).alias("fraction")))
    return (
        curve.groupBy(*by).agg(F.array(*ends).alias("ends"))
        .select(*by, F.transform("ends", lambda e: interpolate(e.low, e.high, e.fraction)).alias("q"))
    )
