"""Approval policy: decisions and what they earn."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import economics
from tidemark.schema import SCORE, TARGET

# Fixed cut-offs 0.02, 0.04 .. 0.54, generated from whole hundredths.
CUTOFF_COUNT = 27


def add_economics(df: DataFrame) -> DataFrame:
    amount, term = F.col("monto_solicitado"), F.col("plazo_meses")
    return (
        df.withColumn("ganancia_si_paga", economics.gain_if_paid(amount, term))
        .withColumn("perdida_si_default", economics.loss_if_default(amount))
        .withColumn("p_umbral", economics.break_even(
            F.col("ganancia_si_paga"), F.col("perdida_si_default")))
    )


def decide(df: DataFrame, score: str = SCORE) -> DataFrame:
    """Add ``aprobar``; needs the columns of :func:`add_economics`."""
    return df.withColumn("aprobar", economics.approves(F.col(score), F.col("p_umbral")))


def realized_value(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Per row: value under the policy, and had everything been approved."""
    value = economics.realized(F.col(target), F.col("ganancia_si_paga"), F.col("perdida_si_default"))
    return (df.withColumn("valor_aprobar_todo", value)
              .withColumn("valor_politica", F.when(F.col("aprobar"), value).otherwise(F.lit(0.0))))


def expected_value(df: DataFrame, score: str = SCORE) -> DataFrame:
    """Per row, without an outcome: expected value of approving."""
    return df.withColumn("ev_aprobar", economics.expected(
        F.col(score), F.col("ganancia_si_paga"), F.col("perdida_si_default")))


def expected_totals(df: DataFrame, by=()) -> DataFrame:
    """Totals over rows carrying ``aprobar`` and ``ev_aprobar``."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_test"),
        F.count_if("aprobar").alias("n_aprob_test"),
        F.sum(F.when(F.col("aprobar"), F.col("ev_aprobar")).otherwise(0.0))
         .alias("ganancia_esperada_politica"),
        F.sum("ev_aprobar").alias("ganancia_esperada_aprobar_todo"),
    )


def value_breakdown(df: DataFrame, by=(), target: str = TARGET) -> DataFrame:
    """Amount and count of the four decision and outcome cells."""
    rejected, bad = ~F.col("aprobar"), F.col(target) == 1
    label = (F.when(rejected & bad, "perdida_evitada")
              .when(rejected, "costo_oportunidad")
              .when(bad, "perdida_no_detectada")
              .otherwise("ganancia_capturada"))
    amount = F.when(bad, F.col("perdida_si_default")).otherwise(F.col("ganancia_si_paga"))
    return (
        df.groupBy(*by, "aprobar", target)
        .agg(F.count("*").alias("n"), F.sum(amount).alias("monto"))
        .withColumn("concepto", label)
    )


def policy_eval(df: DataFrame, by=(), target: str = TARGET) -> DataFrame:
    """Compact result over rows carrying the columns of :func:`realized_value`."""
    avoided = F.when(~F.col("aprobar") & (F.col(target) == 1), F.col("perdida_si_default"))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if("aprobar").alias("n_aprob"),
        F.avg(F.col("aprobar").cast("double")).alias("pct_aprob"),
        F.sum("valor_politica").alias("ganancia_politica"),
        F.sum("valor_aprobar_todo").alias("ganancia_aprobar_todo"),
        F.sum(F.coalesce(avoided, F.lit(0.0))).alias("perdida_evitada"),
    )


def cutoffs_at_or_below(score: Column) -> Column:
    """How many fixed cut-offs the score fails; an unknown score fails all."""
    failed = reduce(lambda a, b: a + b, [
        (score >= F.lit(2 * i / 100)).cast("int") for i in range(1, CUTOFF_COUNT + 1)])
    return F.coalesce(failed, F.lit(CUTOFF_COUNT))


def gain_curve(df: DataFrame, score: str = SCORE, target: str = TARGET) -> DataFrame:
    """Realised gain and share approved for each fixed cut-off.

    A row is approved from the first cut-off above its score onwards, so one
    pass groups rows by that cut-off and a running sum over 28 groups gives
    every total. The alternative, each row against each cut-off, would
    multiply the data by 27.
    """
    value = economics.realized(F.col(target), F.col("ganancia_si_paga"), F.col("perdida_si_default"))
    first = (cutoffs_at_or_below(F.col(score)) + 1).alias("i")
    cutoffs = df.sparkSession.range(1, CUTOFF_COUNT + 1).select(
        F.col("id").cast("int").alias("i"), F.lit(0.0).alias("valor"), F.lit(0).cast("long").alias("n"))
    groups = (
        df.select(first, value.alias("valor"))
        .groupBy("i").agg(F.sum("valor").alias("valor"), F.count("*").alias("n"))
        .unionByName(cutoffs)
        .groupBy("i").agg(F.sum("valor").alias("valor"), F.sum("n").alias("n"))
    )
    up_to = Window.orderBy("i")            # 28 rows
    everything = Window.partitionBy()
    return (
        groups.select(
            "i",
            F.sum("valor").over(up_to).alias("gain"),
            (F.sum("n").over(up_to) / F.sum("n").over(everything)).alias("pct_approved"))
        .where(F.col("i") <= CUTOFF_COUNT)
        .select((F.col("i") * 2 / F.lit(100.0)).alias("threshold"), "gain", "pct_approved")
    )


def threshold_table(df: DataFrame) -> DataFrame:
    """Break-even probability per term; the amount cancels out."""
    base = F.lit(1_000_000.0)
    gain = economics.gain_if_paid(base, F.col("plazo_meses"))
    return (
        df.select("plazo_meses").distinct()
        .withColumn("p_umbral", economics.break_even(gain, economics.loss_if_default(base)))
        .orderBy("plazo_meses")
    )


def policy_output(df: DataFrame, score: str = SCORE) -> DataFrame:
    """The per-application decision record."""
    return df.select(
        "id_solicitud", F.col(score).alias("p_default"), "p_umbral",
        F.col("aprobar").alias("recomendacion_aprobar"), "monto_solicitado", "plazo_meses")
