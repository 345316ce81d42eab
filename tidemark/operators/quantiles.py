"""Exact interpolated quantiles of any numeric column.

Spark's own exact ``percentile`` keeps the distinct values of a group in one
task. Here a bounded sketch first brackets each wanted quantile. Only values
inside the brackets are then kept apart; the rest collapse to one row per gap
between brackets, so what is ordered is a small share of the data and the
answer is still the exact order statistic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.curve import interpolate

SKETCH_ACCURACY = 100_000
MARGIN = 3.0 / SKETCH_ACCURACY      # the sketch errs by at most 1 / accuracy
CELLS = 1_024                       # equal parts of a bracket


def _present(df: DataFrame, value: str, by) -> DataFrame:
    number = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return df.select(*by, number.alias("v")).where(F.col("v").isNotNull())


def _sketch(probabilities) -> Column:
    """One sketch: lower ends of the brackets, then upper ends."""
    low = [max(0.0, p - MARGIN) for p in probabilities]
    high = [min(1.0, p + MARGIN) for p in probabilities]
    return F.percentile_approx("v", low + high, SKETCH_ACCURACY)


def _select_exact(bracketed: DataFrame, probabilities, by) -> DataFrame:
    """``bracketed`` has ``v`` and the bracket ends ``b`` of :func:`_sketch`.

    Brackets are cut into CELLS equal cells. Values are ordered within a cell and
    shifted by the cells before, so no window sees more than a cell, or than the
    list of cells.
    """
    k = len(probabilities)
    ends = [(F.col("b")[i], F.col("b")[k + i]) for i in range(k)]
    v = F.col("v")
    inside = reduce(lambda a, b: a | b, [(v >= low) & (v <= high) for low, high in ends])
    passed = reduce(lambda a, b: a + b, [(v > high).cast("int") for _, high in ends])
    low, high = F.get("b", F.col("gap")), F.get("b", F.col("gap") + k)     # a value inside a bracket is inside this one
    cell = F.when(F.col("inside"), F.coalesce(F.floor(F.try_divide(v - low, high - low) * CELLS), F.lit(0))).otherwise(-1)
    pieces = (
        bracketed.withColumn("gap", passed).withColumn("inside", inside).withColumn("cell", cell)
        .groupBy(*by, "gap", "cell", F.when(F.col("inside"), v).alias("exact"))
        .agg(F.count("*").alias("n"), F.min("v").alias("first"), F.max("v").alias("last"))
    )
    place = [*by, "gap", "cell"]
    cells = pieces.groupBy(*place).agg(F.sum("n").alias("size"))
    running = F.sum("size").over(Window.partitionBy(*by).orderBy("gap", "cell"))
    cells = cells.select(*place, (running - F.col("size")).alias("start"),
                         F.sum("size").over(Window.partitionBy(*by)).alias("total"))
    same = reduce(lambda a, b: a & b, [F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in place])
    within = F.sum("n").over(Window.partitionBy(*place).orderBy("first"))
    ranked = (pieces.withColumn("within", within).alias("p").join(cells.alias("c"), same)
              .select(*[F.col(f"p.{c}") for c in by], "n", "first", "last", F.col("exact").isNotNull().alias("kept"),
                      (F.col("start") + F.col("within")).alias("through"), "total"))
    before = F.col("through") - F.col("n")

    def at_rank(rank):
        # a gap only knows its end values; a rank deeper inside one would mean
        # the sketch broke its bound, and must not pass silently
        value = (F.when(F.col("kept") | (rank == before), F.col("first"))
                  .when(rank == F.col("through") - 1, F.col("last"))
                  .otherwise(F.raise_error(F.lit("quantile bracket missed")).cast("double")))
        return F.max(F.when((before <= rank) & (rank < F.col("through")), value))

    parts = []
    for p in probabilities:
        position = F.lit(float(p)) * (F.col("total") - 1)
        low = F.floor(position)
        parts.append(F.struct(
            at_rank(low).alias("low"),
            at_rank(F.least(low + 1, F.col("total") - 1)).alias("high"),
            F.max(position - low).alias("fraction")))
    return (
        ranked.groupBy(*by).agg(F.array(*parts).alias("parts"), F.max("total").alias("n"))
        .select(*by, "n", F.transform(
            "parts", lambda e: interpolate(e.low, e.high, e.fraction)).alias("q"))
    )


def exact_quantiles(df: DataFrame, value: str, probabilities) -> DataFrame:
    """One row: ``n`` and the quantiles as an array ``q``. Missing values are ignored."""
    data = _present(df, value, ())
    sketch = data.agg(_sketch(probabilities).alias("b")).scalar()
    return _select_exact(data.withColumn("b", sketch), probabilities, [])


def group_quantiles(df: DataFrame, value: str, probabilities, by: list[str],
                    few_groups: bool = False) -> DataFrame:
    """Quantiles per group. Rows without a group are ignored.

    ``few_groups`` states that the number of groups is fixed by the caller (a
    list of column names, say), so their sketches are broadcast; otherwise Spark
    decides by their measured size.
    """
    data = _present(df, value, by).where(
        reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by]))
    sketches = data.groupBy(*by).agg(_sketch(probabilities).alias("b"))
    sketches = F.broadcast(sketches) if few_groups else sketches
    return _select_exact(data.join(sketches, by), probabilities, by)


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """One row with column ``mediana``."""
    return exact_quantiles(df, value, [0.5]).select(F.col("q")[0].alias("mediana"))


def group_median(df: DataFrame, value: str, by: list[str], few_groups: bool = False) -> DataFrame:
    """Columns ``by`` and ``mediana``."""
    return group_quantiles(df, value, [0.5], by, few_groups).select(*by, F.col("q")[0].alias("mediana"))
