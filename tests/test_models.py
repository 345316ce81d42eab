"""Training, persistence and separation of fit and transform."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import encode, impute, logistic, quality
from tidemark.operators.metrics import eval_summary
from tidemark.plans import bakeoff, training
from tidemark.plans.rounds import ROUNDS
from tidemark.schema import CATEGORICAL, IMPUTED, LOGGED, PLAIN, TARGET
from tidemark.sources import sinks


def newton(X, y, c):
    """Minimiser of c times the summed log loss plus half the squared weights."""
    A = np.column_stack([np.ones(len(X)), X])
    ridge = np.diag([0.0] + [1.0] * X.shape[1])
    w = np.zeros(A.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-A @ w))
        step = np.linalg.solve(c * (A.T * (p * (1 - p))) @ A + ridge, c * A.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-12:
            break
    return w


@pytest.fixture(scope="module")
def labelled(apps):
    return quality.between_dates(apps.drop("p_default"), None, "2025-02-15")


@pytest.fixture(scope="module")
def trainer(labelled):
    cfg = ROUNDS[4]
    return training.Trainer(cfg, cfg.train(labelled))


def test_logistic_minimises_the_same_loss(trainer):
    c = 0.1
    scaler, model, _ = trainer.fit(training.Candidate("logistica", (("C", c),)))
    rows = scaler.transform(trainer.frame).select("default_12m", vector_to_array("scaled").alias("x")).toPandas()
    X, y = np.stack(rows.x), rows.default_12m.to_numpy()
    w = newton(X, y, c)
    got = np.concatenate([[model.intercept], model.coefficients.toArray()])
    loss = lambda v: c * np.logaddexp(0, np.where(y == 1, -1, 1) * (v[0] + X @ v[1:])).sum() + (v[1:] ** 2).sum() / 2
    assert loss(got) == pytest.approx(loss(w), rel=1e-7)
    assert got == pytest.approx(w, abs=2e-2)


def test_scaler_uses_population_deviation(spark, trainer):
    scaler, *_ = trainer.fit(training.Candidate("logistica", (("C", 1.0),)))
    X = np.stack(trainer.frame.select(vector_to_array("features").alias("x")).toPandas().x)
    std = X.std(axis=0)
    assert scaler.getScalingVec().toArray() == pytest.approx(1 / np.where(std > 0, std, 1), rel=1e-9)


def test_features(trainer):
    assert trainer.names[:4] == ["flag_ingreso_declarado_nulo_original", "flag_antiguedad_laboral_nulo",
                                 "log_ingreso_declarado", "antiguedad_laboral_meses"]
    assert trainer.names[-3:] == ["canal_digital", "canal_partner", "canal_sucursal"]
    assert "num_contactos_ult_trimestre" not in trainer.names


def test_fit_does_not_see_validation_rows(labelled):
    cfg = ROUNDS[4]
    changed = labelled.withColumn("edad", F.when(F.col("fecha_solicitud") >= "2025-01-01", 99).otherwise(F.col("edad"))) \
        .withColumn("ingreso_declarado", F.when(F.col("fecha_solicitud") >= "2025-01-01", 1e9)
                    .otherwise(F.col("ingreso_declarado")))
    states = []
    for frame in (labelled, changed):
        stages = Pipeline(stages=cfg.feature_stages()[:3]).fit(cfg.train(frame)).stages
        states.append((stages[0].getOrDefault("ageFill"), sorted(map(tuple, stages[2].table(frame.sparkSession).collect()))))
    assert states[0] == states[1]


def test_unseen_label_encodes_as_zeros(spark, trainer, labelled):
    row = labelled.limit(1).withColumn("region", F.lit("elsewhere"))
    vector = trainer.features.transform(row).select("features").first()[0].toArray()
    slots = [i for i, n in enumerate(trainer.names) if n.startswith("region_")]
    assert vector[slots].sum() == 0


def test_round_with_oversampling(labelled, spark, tmp_path):
    cfg = ROUNDS[3]
    t = training.Trainer(cfg, cfg.train(labelled))
    assert "tasa_interes_anual" not in t.names
    grid = [training.Candidate("profundidad", (("max_depth", 3), ("learning_rate", .1), ("n_estimators", 2),
                                               ("min_child_weight", 5)), ratio=r) for r in (None, 0.5)]
    results = training.search(t, cfg.valid(labelled), grid)
    assert results.count() == 2 and {r.n for r in results.collect()} == {cfg.valid(labelled).count()}
    frame, n, rate = t.resampled(0.5)
    assert rate == pytest.approx(1 / 3, abs=1e-2) and frame.count() == n
    model = t.model(grid[1])
    sinks.save_model(spark, model, t.names, str(tmp_path / "m"))
    again = sinks.load_model(str(tmp_path / "m"))
    rows = cfg.valid(labelled)
    a, b = (m.transform(rows).select("id_solicitud", "p_default").orderBy("id_solicitud").collect()
            for m in (model, again))
    assert a == b and all(0 <= r.p_default <= 1 for r in a)


def test_calendar_month_round(labelled):
    cfg = ROUNDS[2]
    t = training.Trainer(cfg, cfg.train(labelled))
    assert [n for n in t.names if n.startswith("mes_solicitud_")][0] == "mes_solicitud_01-enero"
    assert not cfg.refit


def test_windows(spark):
    days = ["2024-01-01", "2024-06-30", "2024-07-01", "2024-12-31", "2025-01-01"]
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "fecha_solicitud date")
    sizes = {n: (c.train(df).count(), c.valid(df).count()) for n, c in ROUNDS.items()}
    assert sizes[1] == (4, 1) and sizes[5] == (2, 2) and sizes[6] == (2, 1)


def test_grids():
    assert len(training.candidates(ROUNDS[1], "logistica")) == 8
    assert len(training.candidates(ROUNDS[3], "logistica")) == 15
    assert len(training.candidates(ROUNDS[4], "hojas")) == 8
    assert len(training.candidates(ROUNDS[3], "profundidad")) == 10
    assert encode.FEATURES == "features"


def test_saved_medians_need_no_stage(spark, tmp_path):
    """20,000 groups of a long key; the staged table is out of reach when the model is used again."""
    rows = spark.range(60_000).selectExpr("id % 20000 AS g", "CAST(id AS DOUBLE) AS x")
    model = impute.GroupMedianImputer(valueCol="x", groupCol="g").fit(rows)
    holes = spark.range(20_100).selectExpr("id AS g", "CAST(NULL AS DOUBLE) AS x")
    want = sorted(map(tuple, model.transform(holes).collect()))
    model.write().save(str(tmp_path / "m"))
    again = impute.GroupMedianModel.load(str(tmp_path / "m"))
    assert again.getOrDefault("mediansPath") == str(tmp_path / "m") + "/medians"
    assert sorted(map(tuple, again.transform(holes).collect())) == want and len(want) == 20_100


def test_quantiles_in_cells(spark):
    """A third of the rows share one value; no window sees all rows."""
    from tidemark.operators import quantiles
    x = np.concatenate([np.full(3000, 5.0), np.random.default_rng(1).exponential(10, 6001)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probabilities = [0, 0.1, 0.25, 0.5, 0.9, 0.995, 1]
    got = quantiles.exact_quantiles(df, "x", probabilities).first().q
    assert got == pytest.approx(np.quantile(x, probabilities).tolist(), abs=1e-12)


def test_policy_of_fitted_rounds(spark):
    import __spark_entry__ as entry
    from conftest import SF_DIR
    sizes = {r.ronda: r.n for r in entry.queries()["round_comparison_fitted"](spark, SF_DIR).collect()}
    rows = {r.ronda: r for r in entry.queries()["policy_round_comparison_fitted"](spark, SF_DIR).collect()}
    assert {k: r.n for k, r in rows.items()} == sizes and len(rows) == 6 and {r.modelo for r in rows.values()} == {"logistica"}
    assert all(0 <= r.n_aprob <= r.n for r in rows.values())
    assert len({r.ganancia_politica for k, r in rows.items() if k != "ronda_5"}) > 1     # one window, but not one model


def test_boosted_models_asked_for(spark, monkeypatch):
    from conftest import SF_DIR
    from tidemark.catalog import queries
    asked, logistic = [], queries.fitted(spark, SF_DIR, 4, "logistica")

    def stand_in(spark, sf_dir, number, family):
        asked.append((number, family))
        return logistic
    monkeypatch.setattr(queries, "fitted", stand_in)
    monkeypatch.setattr(queries.training, "importance_ranked", lambda model: asked.append("ranked"))
    queries.QUERIES["importance_ranked"](spark, SF_DIR)
    assert asked == [(1, "hojas"), "ranked"]
    every = [(n, f) for f in ("hojas", "profundidad") for n in range(1, 7)]
    for name in ("round_comparison_boosted", "policy_round_comparison_boosted"):
        asked.clear()
        rows = queries.QUERIES[name](spark, SF_DIR).collect()
        assert asked == every and sorted((r.ronda, r.modelo) for r in rows) == sorted((f"ronda_{n}", f) for n, f in every)


def tiny_grid():
    return [training.Candidate("profundidad", (("max_depth", d), ("learning_rate", .1), ("n_estimators", 2), ("min_child_weight", 5)),
                               ratio=r) for d in (2, 3) for r in (None, 0.5)]


def test_search_goes_on_where_it_was_cut_short(spark, labelled, monkeypatch):
    from tidemark.session import drop_ledger
    cfg, fitted, new = ROUNDS[3], [], training.Trainer.fit_new

    def dies(self, candidate):
        if len(fitted) == 2:
            raise RuntimeError("driver lost")
        fitted.append(candidate)
        return new(self, candidate)
    drop_ledger(spark)
    monkeypatch.setattr(training, "PARALLEL_FITS", 1)
    monkeypatch.setattr(training.Trainer, "fit_new", dies)
    with pytest.raises(RuntimeError, match="driver lost"):
        training.search(training.Trainer(cfg, cfg.train(labelled)), cfg.valid(labelled), tiny_grid())
    again = []
    monkeypatch.setattr(training.Trainer, "fit_new", lambda self, c: again.append(c) or new(self, c))
    results = training.search(training.Trainer(cfg, cfg.train(labelled)), cfg.valid(labelled), tiny_grid())
    assert len(again) == 2 and set(again).isdisjoint(fitted) and set(again) | set(fitted) == set(tiny_grid())
    kept = [tuple(r) for r in results.orderBy("posicion").collect()]
    assert len(kept) == 4 and training.search(training.Trainer(cfg, cfg.train(labelled)), cfg.valid(labelled), tiny_grid()).count() == 4 and len(again) == 2
    drop_ledger(spark)
    fresh = training.search(training.Trainer(cfg, cfg.train(labelled)), cfg.valid(labelled), tiny_grid())
    assert len(again) == 6 and [tuple(r) for r in fresh.orderBy("posicion").collect()] == kept
    other = labelled.withColumn("edad", F.col("edad") + 1)
    training.search(training.Trainer(cfg, cfg.train(other)), cfg.valid(other), tiny_grid()[:1])
    assert len(again) == 7              # another frame is another fit


def test_split_counts(spark, labelled):
    """By hand: two trees, three inner nodes on feature 4 and one on feature 1; a fitted model's add up to its inner nodes."""
    leaf, node = (-1, -1, -1), lambda f, a, b: (a, b, f)
    trees = [(0, node(4, 1, 2)), (0, leaf), (0, node(1, 3, 4)), (0, leaf), (0, leaf), (1, node(4, 1, 4)), (1, node(4, 2, 3)), (1, leaf), (1, leaf), (1, leaf)]
    nodes = spark.createDataFrame([(t, (a, b, (f,))) for t, (a, b, f) in trees],
                                  "treeID int, nodeData struct<leftChild int, rightChild int, split struct<featureIndex int>>")
    assert {r.position: r.splits for r in training.node_splits(nodes).collect()} == {4: 3, 1: 1}
    cfg = ROUNDS[1]
    fitted = training.fit_round(cfg, labelled, "profundidad", grid=tiny_grid()[::2])
    rows = training.importance_ranked(fitted).collect()
    learner = fitted.final.stages[-2]
    assert sum(r.splits for r in rows) == sum((t.numNodes - 1) // 2 for t in learner.trees) > 0
    assert [r.splits for r in rows] == sorted((r.splits for r in rows), reverse=True) and len(rows) == len(fitted.names)
    assert {r.feature: r.importance for r in rows} == dict(zip(fitted.names, learner.featureImportances.toArray()))
    assert all((r.splits > 0) == (r.importance > 0) for r in rows)


def test_fitted_queries_return_what_the_model_says(spark):
    import __spark_entry__ as entry
    from conftest import SF_DIR
    run = lambda name: entry.queries()[name](spark, SF_DIR).toPandas()
    scores, written, both = run("score"), run("predictions_output"), run("fit_oot_and_final")
    assert scores.p_default.between(0, 1).all() and scores.p_default.nunique() > 100
    assert dict(zip(scores.id_solicitud, scores.p_default)) == dict(zip(written.id_solicitud, written.prob_default))
    final = both[both.modelo == "final"]
    assert dict(zip(final.id_solicitud, final.p_default)) == dict(zip(scores.id_solicitud, scores.p_default))
    oot = both[both.modelo == "oot"].merge(
        entry.queries()["applications_scan"](spark, SF_DIR).select("id_solicitud", "default_12m").toPandas(), on="id_solicitud")
    pos, neg = (oot.p_default[oot.default_12m == k].to_numpy() for k in (1, 0))
    auc = ((pos[:, None] > neg[None, :]).mean() + (pos[:, None] == neg[None, :]).mean() / 2)
    job = run("job_round").iloc[0]
    assert (job.n, job.n_pos) == (len(oot), len(pos)) and job.auc == pytest.approx(auc, abs=1e-4)
    assert job.brier == pytest.approx(((oot.p_default - oot.default_12m) ** 2).mean(), abs=1e-6)
    grid = run("train_logistic")
    assert len(grid) == 8 and grid.auc.between(.5, 1).all() and grid.auc[~grid.balanceado].max() == job.auc
    assert grid.brier[grid.balanceado].min() > grid.brier[~grid.balanceado].max()       # weighting wrecks calibration
    rounds = run("round_comparison_fitted")
    assert len(rounds) == 6 and rounds[rounds.ronda == "ronda_4"].iloc[0].auc == job.auc


def test_logistic_candidates_share_passes_and_reach_the_minimum(labelled, monkeypatch):
    """Weighted or not, from a sample's answer: the minimum over all rows, in passes that don't grow with the grid."""
    from tidemark.operators import logistic
    passes, sums = [], logistic._sums
    monkeypatch.setattr(logistic, "START_ROWS", 300)
    monkeypatch.setattr(logistic, "_sums", lambda *a: passes.append(1) or sums(*a))
    cfg = ROUNDS[4]
    t = training.Trainer(cfg, cfg.train(labelled))
    grid = training.candidates(cfg, "logistica")
    t.solve(grid)
    assert len(grid) == 8 and len(passes) < 40
    rows = t.frame.select("default_12m", vector_to_array("features").alias("x")).toPandas()
    y = rows.default_12m.to_numpy()
    for c in (grid[0], grid[3]):
        scaler, model = t._solved[c]
        X = np.stack(rows.x) * scaler.getScalingVec().toArray()
        weight = np.where(y == 1, *t.weights["logistica"]) if c.balanced else np.ones(len(y))
        w = np.concatenate([[model.intercept], model.coefficients.toArray()])
        p = 1 / (1 + np.exp(-(w[0] + X @ w[1:])))
        slope = np.concatenate([[(weight * (p - y)).sum()], X.T @ (weight * (p - y)) + w[1:] / dict(c.settings)["C"]])
        assert np.abs(slope).max() < 1e-3 * len(y) / 1000, c


def test_final_model_is_fitted_when_asked_for(labelled, monkeypatch):
    cfg, made, init = ROUNDS[4], [], training.Trainer.__init__
    monkeypatch.setattr(training.Trainer, "__init__", lambda self, *a: made.append(1) or init(self, *a))
    grid = [training.Candidate("logistica", (("C", 1.0),))]
    fitted = training.fit_round(cfg, labelled, grid=grid)
    fitted.score(cfg.valid(labelled), final=False).count()
    assert len(made) == 1
    assert fitted.final.stages[-2].coefficients != fitted.oot.stages[-2].coefficients and len(made) == 2 and fitted.names


def test_tasks_of_a_boosted_fit_follow_its_rows(labelled, monkeypatch):
    """Eight files of a few hundred rows: two tasks a job, not eight; more tasks once there are more rows a task."""
    cfg, seen, fit = ROUNDS[1], [], training.GBTClassifier.fit
    t = training.Trainer(cfg, cfg.train(labelled))
    t.frame = t.frame.repartition(8, "id_solicitud")
    n = t.frame.count()
    monkeypatch.setattr(training.GBTClassifier, "fit", lambda self, frame: seen.append(frame.rdd.getNumPartitions()) or fit(self, frame))
    for rows in (training.TASK_ROWS, -(-n // 5)):
        monkeypatch.setattr(training, "TASK_ROWS", rows)
        t.fit_new(tiny_grid()[0])
    assert seen == [2, 5]


def test_recipes_share_the_passes_of_their_fits(labelled, monkeypatch):
    """One table and one series of passes for all recipes, and the answer of a fit for each on its own."""
    passes, sums = [], logistic._sums
    monkeypatch.setattr(logistic, "_sums", lambda factors, settings: passes.append(len(settings)) or sums(factors, settings))
    found = {r.receta: r for r in bakeoff.imputation_bakeoff(labelled).collect()}
    assert passes[0] == len(impute.RECIPES) and len(passes) < 15
    logged = ["ingreso_declarado", *LOGGED]
    numeric = [f"log_{c}" for c in logged] + ["antiguedad_laboral_meses", *PLAIN] + [f"{c}_isnull" for c in IMPUTED]
    for recipe in impute.RECIPES:
        filled = impute.apply_recipe(labelled, recipe)
        train, valid = filled.where("fecha_solicitud < '2025-01-01'"), filled.where("fecha_solicitud >= '2025-01-01'")
        n = train.count()
        model = Pipeline(stages=[
            encode.log_stage(logged), *encode.one_hot_stages(CATEGORICAL), encode.assemble_stage(numeric, CATEGORICAL),
            encode.NoCenterScaler(), LogisticRegression(featuresCol="scaled", labelCol=TARGET, regParam=1.0 / n, tol=1e-12,
                                                        standardization=False, maxIter=2000)]).fit(train)
        alone = eval_summary(training.ProbabilityColumn().transform(model.transform(valid))).first()
        assert found[recipe].auc_valid == pytest.approx(alone.auc, abs=2e-5)
        assert (found[recipe].n_train, found[recipe].n_valid) == (n, alone.n)


def test_bakeoff_of_one_class(labelled):
    """No minimum to find: all scores are equal."""
    rows = bakeoff.imputation_bakeoff(labelled.where(f"{TARGET} = 0 OR fecha_solicitud >= '2025-01-01'")).collect()
    assert [r.auc_valid for r in rows] == [0.5] * len(impute.RECIPES)


def test_fit_on_some_of_the_columns(spark):
    """A setting that uses some slots has the minimum over these alone."""
    rng = np.random.default_rng(3)
    X = rng.normal(size=(400, 3))
    y = (X @ [1.0, -2.0, 0.5] + rng.logistic(size=400) > 0).astype(float)
    frame = spark.createDataFrame([(i, *map(float, x), t) for i, (x, t) in enumerate(zip(X, y.tolist()))], "id long, a double, b double, c double, y double")
    some, whole = logistic.Setting(1.0, slots=[0, 2]), logistic.Setting(1.0)
    logistic.fit(frame, ["a", "b", "c"], "y", "id", [1.0, 1.0, 1.0], [some, whole])
    for w, x in ((some.w[[0, 1, 3]], X[:, [0, 2]]), (whole.w, X)):
        residual = 1 / (1 + np.exp(-(w[0] + x @ w[1:]))) - y
        assert np.r_[residual.sum(), x.T @ residual + w[1:]] == pytest.approx(0, abs=1e-5)
    assert some.w[2] == 0
