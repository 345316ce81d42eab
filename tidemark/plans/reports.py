"""Result tables in long form, ready for any sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import metrics, policy
from tidemark.schema import SCORE, TARGET


def _long(df: DataFrame, table: str, keys: list[str], values: list[str]) -> DataFrame:
    """``tabla, clave, medida, valor`` from a table of a few rows."""
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    pairs = F.explode(F.array(*[
        F.struct(F.lit(v).alias("medida"), F.col(v).cast("double").alias("valor")) for v in values]))
    return (df.select(F.lit(table).alias("tabla"), key.alias("clave"), pairs.alias("p"))
              .select("tabla", "clave", "p.*"))


def report_tables(valid: DataFrame, test: DataFrame, score: str = SCORE) -> DataFrame:
    """Deciles on the validation rows, and histograms of both sets on one scale.

    A pure function of the scored rows, so it can be run again.
    """
    both = valid.select(F.lit("valid").alias("conjunto"), score).unionByName(
        test.select(F.lit("test").alias("conjunto"), score))
    high = F.greatest(F.col("max_comun"), F.lit(metrics.HIST_MIN_RANGE))
    high = metrics.common_hist_max(both, ["conjunto"], score).select(high).scalar()
    return reduce(DataFrame.unionByName, [
        _long(metrics.decile_table(valid, score), "deciles_valid", ["decile"],
              ["n", "avg_pred", "default_rate"]),
        _long(metrics.score_hist(valid, high, score, TARGET), "hist_valid", ["bin"],
              ["n_default", "n_no_default"]),
        _long(metrics.score_hist(test, high, score), "hist_test", ["bin"], ["n"]),
    ])


def policy_report(valid: DataFrame, test: DataFrame, score: str = SCORE) -> DataFrame:
    """Realised value on labelled rows, expected value on the others, and the
    tables behind them."""
    v = policy.realized_value(policy.decide(policy.add_economics(valid), score))
    t = policy.expected_value(policy.decide(policy.add_economics(test), score), score)
    return reduce(DataFrame.unionByName, [
        _long(policy.policy_eval(v), "politica_valid", [],
              ["n", "n_aprob", "pct_aprob", "ganancia_politica", "ganancia_aprobar_todo", "perdida_evitada"]),
        _long(policy.value_breakdown(v), "desglose", ["concepto"], ["n", "monto"]),
        _long(policy.gain_curve(v, score).withColumn("threshold", F.format_number("threshold", 2)),
              "curva", ["threshold"], ["gain", "pct_approved"]),
        _long(policy.threshold_table(v), "umbral_por_plazo", ["plazo_meses"], ["p_umbral"]),
        _long(metrics.score_hist(v, metrics.hist_max(v, score, floor=None), score), "hist_p_valid", ["bin"], ["n"]),
        _long(policy.expected_totals(t), "politica_test", [],
              ["n_test", "n_aprob_test", "ganancia_esperada_politica", "ganancia_esperada_aprobar_todo"]),
        _long(metrics.score_hist(t, metrics.hist_max(t, score, floor=None), score), "hist_p_test", ["bin"], ["n"]),
    ])


def compare_rounds(results: dict[str, DataFrame]) -> DataFrame:
    """One table from the metric or policy rows of several rounds."""
    return reduce(DataFrame.unionByName, [
        df.withColumn("ronda", F.lit(name)) for name, df in results.items()])


def policy_uplift(results: DataFrame) -> DataFrame:
    """Gain of the policy as a multiple of approving everything."""
    return results.withColumn("veces_aprobar_todo", F.try_divide(
        "ganancia_politica", "ganancia_aprobar_todo"))
