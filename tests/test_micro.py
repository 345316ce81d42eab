"""Small inputs with known answers."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.calendar import with_rate_cap
from tidemark.functions.probability import hard_predict, prior_correction
from tidemark.functions.pvalues import chi2_tail, f_tail
from tidemark.operators import balance, encode, impute, metrics, policy, quality, quantiles
from tidemark.plans.training import select_brier_guard, select_calibration_safe
from tidemark.sources import sinks
from tidemark.sources.applications import nan_to_null


def values(df, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


@pytest.fixture(scope="module")
def ties(spark):
    return spark.createDataFrame(
        [(.9, 1), (.8, 0), (.7, 1), (.6, 0), (.6, 1), (.1, 0)], "p_default double, default_12m int")


def test_median_and_percentiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,), (float("nan"),)], "x double")
    assert quantiles.exact_median(df, "x").first().mediana == 2.5
    q = quantiles.exact_quantiles(df, "x", [0.1, 0.995]).first()
    assert q.q == pytest.approx([1.3, 3.985]) and q.n == 4


def test_median_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert df.select(quantiles.exact_median(df, "x").scalar().alias("m")).first().m is None


def test_group_median_impute(spark):
    fit = spark.createDataFrame(
        [(1.0, "A"), (3.0, "A"), (None, "A"), (10.0, "D"), (None, "B")],
        "ingreso_declarado double, tipo_empleo string")
    model = impute.GroupMedianImputer().fit(fit)
    new = spark.createDataFrame(
        [(1, None, "A"), (2, None, "B"), (3, None, None), (4, None, "C"), (5, 7.0, "A")],
        "i int, ingreso_declarado double, tipo_empleo string")
    got = dict(values(model.transform(new), "i", "ingreso_declarado"))
    assert got == {1: 2.0, 2: 3.0, 3: 3.0, 4: 3.0, 5: 7.0}


def test_group_medians_of_many_groups(spark):
    fit = spark.range(40).select((F.col("id") * 1.0).alias("ingreso_declarado"),
                                 (F.col("id") % 20).cast("string").alias("tipo_empleo"))
    model = impute.GroupMedianImputer().fit(fit)
    new = spark.createDataFrame([(None, "3"), (None, "x")], "ingreso_declarado double, tipo_empleo string")
    assert sorted(values(model.transform(new), "ingreso_declarado")) == [13.0, 19.5]


def test_clean_age_income(spark):
    ages = spark.createDataFrame([(17,), (18,), (100,), (101,), (None,)], "edad int")
    out = quality.clean_age(ages, 39.0)
    assert values(out, "flag_edad_inconsistente") == [1, 0, 0, 1, 0]
    assert values(out, "edad") == [39.0, 18.0, 100.0, 39.0, None]
    income = spark.createDataFrame([(200000.0,), (200001.0,), (None,)], "ingreso_declarado double")
    out = quality.clean_income(income)
    assert values(out, "ingreso_declarado", "flag_ingreso_inconsistente") == [(None, 1), (200001.0, 0), (None, 0)]


@pytest.mark.parametrize("day, amount, step, cap", [
    ("2024-03-16", 1000.0, False, 40.23), ("2024-03-16", 1000.0, True, 41.06),
    ("2026-01-01", 1000.0, False, 39.08), ("2026-01-01", 3e6, False, 32.08),
    ("2026-01-01", 9e6, False, 27.12), ("2026-01-01", None, False, 27.12),
    ("2020-01-01", 1000.0, False, 41.68),
    ("2026-01-01", 50 * 38452.14, False, 39.08), ("2026-01-01", 200 * 38452.14, False, 32.08),
])
def test_rate_cap(spark, day, amount, step, cap):
    df = spark.createDataFrame([(dt.date.fromisoformat(day), amount)],
                               "fecha_solicitud date, monto_solicitado double")
    assert with_rate_cap(df, step=step).first().tope_tasa == pytest.approx(cap)


def test_uf(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 8), 1.0)], "fecha_solicitud date, monto_solicitado double")
    assert with_rate_cap(df).first().uf == pytest.approx(36812.915)


def test_rate_at_and_above_cap(spark):
    df = spark.createDataFrame([(dt.date(2026, 1, 1), 1000.0, 39.08), (dt.date(2026, 1, 1), 1000.0, 39.09)],
                               "fecha_solicitud date, monto_solicitado double, tasa_interes_anual double")
    out = quality.clean_rate(df)
    assert sorted(values(out, "tasa_interes_anual", "flag_tasa_corregida")) == [(39.08, 0), (39.08, 1)]


def test_nan_is_missing(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"),)], "tasa_interes_anual double"))
    assert df.first()[0] is None


def test_one_hot_unseen(spark):
    df = spark.createDataFrame([("a",), ("c",), ("zz",), (None,)], "x string")
    out = encode.one_hot_columns(df, {"x": ["a", "b", "c"]})
    assert values(out, "x_a", "x_b", "x_c") == [(1, 0, 0), (0, 0, 1), (0, 0, 0), (0, 0, 0)]


def test_metrics_with_ties(ties):
    m = metrics.eval_summary(ties).first()
    assert (m.auc, m.pr_auc) == pytest.approx((0.722222, 0.755556), abs=1e-6)
    assert m.gini == pytest.approx(2 * m.auc - 1) and (m.n, m.n_pos) == (6, 3)


def test_missing_score_is_an_error(spark):
    df = spark.createDataFrame([(None, 1), (.2, 0)], "p_default double, default_12m int")
    with pytest.raises(Exception, match="missing score"):
        metrics.eval_summary(df).collect()


def test_one_class_only(spark):
    df = spark.createDataFrame([(.1, 0), (.2, 0)], "p_default double, default_12m int")
    m = metrics.eval_summary(df).first()
    assert m.auc is None and m.ks is None and m.brier == pytest.approx(0.025)


def test_equal_scores_make_one_decile(spark):
    df = spark.createDataFrame([(.3, 1), (.3, 0)], "p_default double, default_12m int")
    assert [(r.decile, r.n) for r in metrics.decile_table(df).collect()] == [(1, 2)]


def test_histogram_ends(spark):
    df = spark.createDataFrame([(0.0, 0), (0.6, 1), (0.61, 0)], "p_default double, default_12m int")
    got = {r.bin: r.n for r in metrics.score_hist(df, 0.6).collect() if r.n}
    assert got == {1: 1, 30: 1, 31: 1}


def test_prior_correction(spark):
    df = spark.createDataFrame([(.5,), (0.0,), (1.0,)], "p double")
    assert values(df.select(prior_correction(F.col("p"), .1, .5).alias("c")), "c") == pytest.approx([.1, 0, 1])
    assert values(df.select(prior_correction(F.col("p"), .3, .3).alias("c")), "c") == pytest.approx([.5, 0, 1])
    assert values(df.select(hard_predict(F.col("p")).alias("c")), "c") == [1, 0, 1]


def test_thresholds_and_decision(spark):
    df = spark.createDataFrame([(m, 100.0) for m in (6, 12, 18, 24, 36, 48)],
                               "plazo_meses int, monto_solicitado double")
    got = [r.p_umbral for r in policy.threshold_table(df).collect()]
    assert got == pytest.approx([.051724, .098361, .140625, .179104, .246575, .303797], abs=1e-6)
    at = policy.add_economics(df).withColumn("p_default", F.col("p_umbral"))
    assert values(policy.decide(at), "aprobar") == [False] * 6


def test_zero_amount_is_rejected(spark):
    df = spark.createDataFrame([(12, 0.0, .01), (12, 5.0, None), (12, 5.0, float("nan"))],
                               "plazo_meses int, monto_solicitado double, p_default double")
    out = policy.decide(policy.add_economics(df))
    assert values(out, "aprobar") == [False] * 3
    assert out.first().p_umbral is None


def test_selection(spark):
    rows = [(0, "a", False, None, .80, .0900), (1, "a", False, 0.3, .85, .0985), (2, "a", False, 0.5, .90, .0995),
            (3, "b", True, None, .99, .2)]
    df = spark.createDataFrame(
        rows, "posicion int, arquitectura string, balanceado boolean, ratio double, auc double, brier double")
    assert select_brier_guard(df.where("arquitectura = 'a'")).first().posicion == 1
    assert select_calibration_safe(df).first().posicion == 2
    tie = spark.createDataFrame([(1, False, .5), (0, False, .5)], "posicion int, balanceado boolean, auc double")
    assert select_calibration_safe(tie).first().posicion == 0


def test_class_weights(spark):
    df = spark.createDataFrame([(1,)] + [(0,)] * 3, "default_12m int")
    w = balance.class_weights(df).first()
    assert (w.peso_pos, w.scale_pos_weight) == (2.0, 3.0) and w.peso_neg == pytest.approx(2 / 3)


def test_predictions_are_checked(spark):
    ids = spark.createDataFrame([(1,), (2,)], "id_solicitud long")
    schema = "id_solicitud long, prob_default double"
    assert sinks.check_predictions(spark.createDataFrame([(1, .1), (2, 1.0)], schema), ids)["n"] == 2
    for bad in ([(1, .1)], [(1, .1), (2, .2), (3, .3)], [(1, .1), (1, .1), (2, .2)], [(1, .1), (2, 1.5)],
                [(1, .1), (2, None)]):
        with pytest.raises(ValueError):
            sinks.check_predictions(spark.createDataFrame(bad, schema), ids)


def test_split_guard(spark):
    df = spark.createDataFrame([(dt.date(2025, 1, 1),)], "fecha_solicitud date")
    with pytest.raises(Exception, match="after 2024"):
        quality.split_guard(df, 2024).collect()


def test_tail_probabilities():
    # table values: chi-square and F at the 5 % point
    assert chi2_tail(3.841459, 1) == pytest.approx(.05, abs=1e-6)
    assert chi2_tail(18.307038, 10) == pytest.approx(.05, abs=1e-6)
    assert chi2_tail(0.1, 1) == pytest.approx(.751830, abs=1e-6)
    assert f_tail(4.964603, 1, 10) == pytest.approx(.05, abs=1e-6)
    assert f_tail(2.866081, 4, 20) == pytest.approx(.05, abs=1e-6)
    assert f_tail(0.5, 4, 20) == pytest.approx(.736, abs=1e-3)


def test_rank_correlations_are_summed_by_task(spark):
    """Ties, a missing value and a constant; no correlation aggregate over the joined ranks, which took a third of the time."""
    from tidemark.operators import eda
    rows = [(1.0, 5.0, 2.0), (2.0, 5.0, 2.0), (2.0, 1.0, 2.0), (4.0, 0.0, 2.0), (9.0, -3.0, 2.0), (None, 7.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(3)
    found = eda.spearman_corr(df, ["a", "b", "c"])
    assert "corr(" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.var_a, r.var_b): r.r for r in found.collect()}
    want = np.corrcoef([1, 2.5, 2.5, 4, 5], [4.5, 4.5, 3, 2, 1])[0, 1]
    assert got[("a", "b")] == pytest.approx(want, abs=1e-12) and got[("a", "c")] is None and len(got) == 3
    assert [r.r for r in eda.spearman_corr(df.where("a > 100"), ["a", "b"]).collect()] == [None]


def test_levene_rows_are_not_dealt_by_a_few_groups(spark):
    """Without broadcasts by size: the long rows meet their brackets and centres where they are, with the same answer."""
    from tidemark.operators import eda
    df = spark.createDataFrame([(float(i * i % 17), float(i % 5), i % 2) for i in range(60)], "a double, b double, g int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        few, many = (eda.levene_test(df, ["a", "b"], "g", few_groups=b) for b in (True, False))
        joins = [f._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin ") for f in (few, many)]
        rows = [sorted((r.variable, r.n, round(r.f, 9)) for r in f.collect()) for f in (few, many)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert joins == [2, 8] and rows[0] == rows[1] and len(rows[0]) == 2
