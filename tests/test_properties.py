"""Properties that hold for any input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import eda, metrics, policy, quality, quantiles
from tidemark.operators.curve import score_counts, score_curve


@pytest.fixture(scope="module")
def noisy(spark):
    """A third of the rows share one value; the rest is continuous."""
    rng = np.random.default_rng(3)
    n = 6000
    x = np.where(rng.random(n) < 1 / 3, 5.0, rng.lognormal(1, 2, n))
    frame = pd.DataFrame({"id": np.arange(n), "x": x, "g": rng.choice(list("abc"), n, p=[.7, .2, .1]),
                          "p_default": np.clip(x / (1 + x), 0, 1), "default_12m": (rng.random(n) < .2).astype(int)})
    return spark.createDataFrame(frame), frame


def test_quantiles_equal_numpy(noisy):
    df, frame = noisy
    probs = [0.0, 0.001, 0.1, 0.25, 0.5, 0.9, 0.995, 1.0]
    got = quantiles.exact_quantiles(df, "x", probs).first().q
    assert got == pytest.approx(np.quantile(frame.x, probs), rel=1e-13)
    for row in quantiles.group_quantiles(df, "x", probs, ["g"]).collect():
        assert row.q == pytest.approx(np.quantile(frame.x[frame.g == row.g], probs), rel=1e-13)


def test_quantiles_with_coarse_sketch(noisy, monkeypatch):
    # wide brackets exercise the counting of values outside and between them
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 50)
    monkeypatch.setattr(quantiles, "MARGIN", 3 / 50)
    df, frame = noisy
    probs = [i / 10 for i in range(11)]
    assert quantiles.exact_quantiles(df, "x", probs).first().q == pytest.approx(
        np.quantile(frame.x, probs), rel=1e-13)


def test_group_quantiles_without_broadcast(noisy):
    df, frame = noisy
    got = {r.g: r.mediana for r in quantiles.group_median(df, "x", ["g"]).collect()}
    assert got == pytest.approx(frame.groupby("g").x.median().to_dict())


def test_curve_counts_every_row(noisy):
    df, frame = noisy
    curve = score_curve(score_counts(df)).toPandas().sort_values("score", ascending=False)
    assert (curve.cum_pos.to_numpy() == curve.pos.cumsum().to_numpy()).all()
    assert (curve.cum_neg.to_numpy() == curve.neg.cumsum().to_numpy()).all()
    assert curve.pos.sum() + curve.neg.sum() == len(frame)


def test_metrics_do_not_depend_on_partitions(noisy):
    df, _ = noisy
    base = metrics.eval_summary(df).first()
    other = metrics.eval_summary(df.repartition(13).orderBy(F.rand(1))).first()
    assert list(other) == pytest.approx(list(base), rel=1e-12)


def test_auc_survives_monotone_change(noisy):
    df, _ = noisy
    squared = df.withColumn("p_default", F.col("p_default") ** 2)
    a, b = metrics.eval_summary(df).first(), metrics.eval_summary(squared).first()
    assert (a.auc, a.ks, a.pr_auc) == pytest.approx((b.auc, b.ks, b.pr_auc), rel=1e-12)


def test_tables_count_every_row(noisy):
    df, frame = noisy
    assert sum(r.n for r in metrics.decile_table(df).collect()) == len(frame)
    hist = metrics.score_hist(df, metrics.hist_max(df), target="default_12m").collect()
    assert sum(r.n_default + r.n_no_default for r in hist) == len(frame)


def test_deciles_equal_pandas(noisy):
    df, frame = noisy
    codes = pd.qcut(frame.p_default, 10, labels=False, duplicates="drop") + 1
    expected = frame.groupby(codes).size().sort_index(ascending=False).tolist()
    assert [r.n for r in metrics.decile_table(df).collect()] == expected


def test_histogram_equals_numpy(noisy):
    df, frame = noisy
    high = min(1.0, np.quantile(frame.p_default, .995))
    counts, _ = np.histogram(frame.p_default, bins=30, range=(0, high))
    got = {r.bin: r.n for r in metrics.score_hist(df, metrics.hist_max(df)).collect()}
    assert [got[i + 1] for i in range(30)] == counts.tolist()


def test_spearman_equals_pandas(noisy):
    df, frame = noisy
    got = eda.spearman_corr(df, ["x", "default_12m"]).first().r
    assert got == pytest.approx(frame[["x", "default_12m"]].corr("spearman").iloc[0, 1], rel=1e-10)


def test_drift_finds_a_planted_shift(spark):
    """Ten defaults in 100 as predicted, from month 13 on 20; against the recursion, with rows that don't count."""
    import datetime as dt
    rows = [(dt.date(2022 + m // 12, m % 12 + 1, 1 + i % 28), int(i < (10 if m < 12 else 20)), 0.1) for m in range(24) for i in range(100)]
    odd = [(None, 1, 0.1), (dt.date(2022, 1, 5), None, 0.1), (dt.date(2022, 1, 5), 1, None), (dt.date(2021, 12, 1), 1, 1.0)]
    schema = "fecha_solicitud date, default_12m int, p_default double"
    got = eda.default_drift(spark.createDataFrame(rows + odd, schema), "p_default").orderBy("mes").collect()
    up = down = 0.0
    for row, m in zip(got, range(-1, 24), strict=True):
        z = 0.0 if m < 12 else (20 - 10) / np.sqrt(100 * 0.1 * 0.9)
        up, down = max(0.0, up + z - 0.5), max(0.0, down - z - 0.5)
        assert (row.n, row.z, row.alza, row.baja) == (1 if m < 0 else 100, *map(pytest.approx, (z, up, down)))
        assert row.deriva == ("alza" if up > 4 else "no")
    assert min(r.mes for r in got if r.deriva == "alza") == dt.date(2023, 2, 1)
    assert eda.default_drift(spark.createDataFrame([], schema), "p_default").count() == 0


def test_gain_curve_equals_direct_sums(apps):
    df = policy.add_economics(apps)
    frame = df.toPandas()
    value = np.where(frame.default_12m == 1, -frame.perdida_si_default, frame.ganancia_si_paga)
    for row in policy.gain_curve(df).collect():
        passed = frame.p_default < row.threshold
        assert row.gain == pytest.approx(value[passed].sum())
        assert row.pct_approved == pytest.approx(passed.mean())


def test_policy_identities(apps):
    d = policy.realized_value(policy.decide(policy.add_economics(apps)))
    cells = {r.concepto: r for r in policy.value_breakdown(d).collect()}
    total = policy.policy_eval(d).first()
    amount = {k: r.monto for k, r in cells.items()}
    assert amount["ganancia_capturada"] - amount["perdida_no_detectada"] == pytest.approx(total.ganancia_politica)
    assert (amount["ganancia_capturada"] + amount["costo_oportunidad"] - amount["perdida_no_detectada"]
            - amount["perdida_evitada"]) == pytest.approx(total.ganancia_aprobar_todo)
    assert cells["ganancia_capturada"].n + cells["perdida_no_detectada"].n == total.n_aprob


def test_cleaned_age_is_valid(apps):
    out = quality.clean(apps, quality.valid_age_median(apps).scalar())
    assert out.where(~F.col("edad").between(18, 100)).count() == 0
    assert out.count() == apps.count()


def test_breusch_pagan_two_regressors(noisy):
    df, frame = noisy
    X = np.column_stack([np.ones(len(frame)), frame.x, frame.p_default])
    residual = frame.default_12m - X @ np.linalg.lstsq(X, frame.default_12m, rcond=None)[0]
    e2 = residual ** 2
    fitted = X @ np.linalg.lstsq(X, e2, rcond=None)[0]
    r2 = 1 - ((e2 - fitted) ** 2).sum() / ((e2 - e2.mean()) ** 2).sum()
    assert eda.breusch_pagan(df, "default_12m", ["x", "p_default"]).first().lm == pytest.approx(len(frame) * r2, rel=1e-6)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().toString().split("== Initial Plan ==")[0]


def test_scores_are_read_once(spark, tmp_path, noisy):
    """The branches of the curve share one shuffle of the counted scores."""
    path = str(tmp_path / "scored")
    noisy[0].write.parquet(path)
    stored = spark.read.parquet(path)
    for frame in (metrics.eval_summary(stored), metrics.eval_summary(stored, by=["g"])):
        plan = final_plan(frame)
        assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_no_query_plan_has_a_cross_join(spark, apps):
    frames = [
        metrics.decile_table(apps), metrics.score_hist(apps, metrics.hist_max(apps)),
        policy.gain_curve(policy.add_economics(apps)), quality.clean(apps, quality.valid_age_median(apps).scalar()),
        eda.quantile_bins(apps, ["edad", "score_buro"]), eda.spearman_corr(apps, ["edad", "score_buro"])]
    for frame in frames:
        plan = final_plan(frame)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_no_task_orders_all_rows(spark):
    """The only window without a partition is over the list of cells."""
    df = spark.range(50_000).selectExpr("rand(3) * 1000 AS x")
    q = quantiles.exact_quantiles(df, "x", [0.25, 0.5])
    q.collect()
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    unpartitioned = [line for line in plan.splitlines() if "Window" in line and "windowspecdefinition(first" in line]
    assert not unpartitioned
