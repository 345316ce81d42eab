"""Ranking and calibration metrics, decile and histogram tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.curve import score_counts, score_curve, score_quantiles
from tidemark.schema import SCORE, TARGET

HIST_BINS = 30
HIST_QUANTILE = 0.995
HIST_MIN_RANGE = 0.05
DECILES = [i / 10 for i in range(11)]


def _areas() -> dict[str, Column]:
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    cum_pos, cum_neg = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    total_pos, total_neg = F.max("total_pos").cast("double"), F.max("total_neg").cast("double")
    # A bad case outranks a good one when it scores higher; ties count half.
    auc = F.try_divide(F.sum(neg * (cum_pos - pos / 2)), total_pos * total_neg)
    gap = F.abs(F.try_divide(cum_pos, F.col("total_pos").cast("double"))
                - F.try_divide(cum_neg, F.col("total_neg").cast("double")))
    # Step sum of precision over recall, not the trapezoid.
    precision = F.try_divide(F.sum(pos * cum_pos / (cum_pos + cum_neg)), total_pos)
    squared = pos * F.pow(F.col("score") - 1, F.lit(2)) + neg * F.pow(F.col("score"), F.lit(2))
    brier = F.sum(squared) / F.sum(pos + neg)
    return {"auc": auc, "gini": 2 * auc - 1, "ks": F.max(gap), "pr_auc": precision, "brier": brier}


def curve_metrics(curve: DataFrame, by=()) -> DataFrame:
    """Every metric of a score set from one aggregation over its curve."""
    return curve.groupBy(*by).agg(
        *[column.alias(name) for name, column in _areas().items()],
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        F.sum("pos").alias("n_pos"),
        (F.sum("pos") / F.sum(F.col("pos") + F.col("neg"))).alias("default_rate"),
    )


def eval_summary(scored: DataFrame, score: str = SCORE, target: str = TARGET, by=()) -> DataFrame:
    """AUC, Gini, KS, average precision, Brier, sizes and default rate."""
    return curve_metrics(score_curve(score_counts(scored, score, target, by), by), by)


def brier(scored: DataFrame, score: str = SCORE, target: str = TARGET, by=()) -> DataFrame:
    """Brier score alone needs no ordering: one aggregation over the rows."""
    return scored.groupBy(*by).agg(
        F.avg(F.pow(F.col(score) - F.col(target), F.lit(2))).alias("brier"))


def decile_table(scored: DataFrame, score: str = SCORE, target: str = TARGET) -> DataFrame:
    """Equal-frequency score groups, closed on the right, ties kept together.

    Repeated edges collapse, so fewer than ten groups may come out; when all
    scores are equal there is one.
    """
    counts = score_counts(scored, score, target)
    edges = F.array_distinct(score_quantiles(score_curve(counts), DECILES).select("q").scalar())
    # ten comparisons against the edge array; a repeated edge is counted once
    binned = counts.withColumn("edges", edges)
    below = reduce(lambda a, b: a + b, [
        F.coalesce((F.get("edges", F.lit(i)) < F.col("score")).cast("int"), F.lit(0))
        for i in range(len(DECILES))])
    n = F.sum(F.col("pos") + F.col("neg"))
    return (
        binned.withColumn("decile", F.greatest(below, F.lit(1)))
        .groupBy("decile").agg(
            n.alias("n"),
            (F.sum(F.col("score") * (F.col("pos") + F.col("neg"))) / n).alias("avg_pred"),
            (F.sum("pos") / n).alias("default_rate"))
        .orderBy(F.desc("decile"))
    )


def hist_max(scored: DataFrame, score: str = SCORE, floor: float | None = HIST_MIN_RANGE,
             target: str | None = None) -> Column:
    """Upper end of a histogram: the 99.5 % quantile, at most 1, at least ``floor``.

    Name the ``target`` of a histogram by class, and both use the same counts.
    """
    curve = score_curve(score_counts(scored, score, target))
    high = F.least(F.lit(1.0), F.col("q")[0])
    if floor is not None:
        high = F.greatest(high, F.lit(floor))
    return score_quantiles(curve, [HIST_QUANTILE]).select(high).scalar()


def common_hist_max(scored: DataFrame, by: list[str], score: str = SCORE) -> DataFrame:
    """Largest 99.5 % quantile over several score sets (not capped at 1)."""
    curve = score_curve(score_counts(scored, score, None, by), by)
    return score_quantiles(curve, [HIST_QUANTILE], by).agg(F.max(F.col("q")[0]).alias("max_comun"))


def _bin(value: Column, high: Column) -> Column:
    """1-based bin, closed on the left, the last one on both sides."""
    step = high / F.lit(float(HIST_BINS))
    guess = F.least(F.floor(value * F.lit(float(HIST_BINS)) / high), F.lit(HIST_BINS - 1)).cast("int")
    # the quotient may round across an edge, so compare with the edges themselves
    lower = guess - (value < guess * step).cast("int")
    exact = lower + ((value >= (guess + 1) * step) & (guess < HIST_BINS - 1)).cast("int")
    return exact + 1


def score_hist(scored: DataFrame, high: Column | float, score: str = SCORE,
               target: str | None = None) -> DataFrame:
    """Histogram on [0, high]; row 31 counts scores above it.

    With a target the counts are given per class on common edges.
    """
    counts = score_counts(scored, score, target)
    high = high if isinstance(high, Column) else F.lit(float(high))
    bins = F.when(F.col("score") > F.col("high"), F.lit(HIST_BINS + 1)) \
            .otherwise(_bin(F.col("score"), F.col("high")))
    empty = scored.sparkSession.range(1, HIST_BINS + 2).select(
        F.col("id").cast("int").alias("bin"),
        F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
    filled = (
        counts.where(F.col("score") >= 0).withColumn("high", high)
        .groupBy(bins.alias("bin")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .unionByName(empty)
        .groupBy("bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    step = high / F.lit(float(HIST_BINS))
    edges = filled.select(
        "bin", ((F.col("bin") - 1) * step).alias("edge_lo"),
        F.when(F.col("bin") <= HIST_BINS, F.col("bin") * step).alias("edge_hi"), "pos", "neg")
    if target is None:
        return edges.withColumnRenamed("neg", "n").drop("pos")
    return edges.withColumnsRenamed({"pos": "n_default", "neg": "n_no_default"})
