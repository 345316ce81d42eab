"""One query per operator, over the applications derived from the given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import MEDIUM_AMOUNT_UF, RATE_CAPS, SMALL_AMOUNT_UF, month_label, with_rate_cap
from tidemark.functions.probability import hard_predict, prior_correction
from tidemark.operators import balance, eda, encode, impute, metrics, policy, quality, temporal
from tidemark.plans import bakeoff, reports, training
from tidemark.plans.rounds import ROUNDS
from tidemark.schema import (APPLICATIONS, CATEGORICAL, DATE, ID, LEAK, QUALITY_FLAGS, SCORE, TARGET, UNRELIABLE,
                             feature_columns)
from tidemark.session import drop_ledger, spread, stage_path, table_state, write_stage
from tidemark.sources import sinks
from tidemark.sources.applications import (LABELLED_UNTIL, applications, p_proxy,
                                           read_applications)
from tidemark.streaming import jobs

SPLIT = "2025-01-01"
RATIOS = ["auc", "gini", "ks", "pr_auc", "brier", "default_rate"]
BANDS = ("hasta_50", "hasta_200", "sobre_200")
NUMERIC = ["score_buro", "tasa_interes_anual", "num_consultas_buro_3m", "uso_linea_credito_pct",
           "edad", "deuda_sistema", LEAK, "ingreso_declarado", "antiguedad_laboral_meses",
           "antiguedad_cliente_meses", "num_creditos_vigentes", "peor_morosidad_12m",
           "monto_solicitado", "plazo_meses"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_SHARED: dict = {}


def shared(spark, key: tuple, build: Callable):
    """Build once per application and state of the tables; later queries reuse the result."""
    sf_dir = key[1]
    state = tuple(table_state(spark, f"{sf_dir}/{name}.parquet") for name in ("orders", "lineitem", "customer"))
    key = (spark.sparkContext.applicationId, state, *key)
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]


def forget_fits() -> None:
    """Drops shared models, so that the next query that needs one fits it."""
    drop_ledger(SparkSession.getActiveSession())
    for key in [k for k in _SHARED if "applications" not in k]:
        del _SHARED[key]


def stored(spark, sf_dir) -> DataFrame:
    """The applications table: derived once per application and kept in the
    shared folder, as a user would keep it. Queries then read only the columns
    they need, and date windows skip row groups."""
    def write():
        path = stage_path(spark, "applications")
        spread(applications(spark, sf_dir), ID).sortWithinPartitions("fecha_solicitud").write.parquet(path)
        return path

    return spark.read.schema(APPLICATIONS).parquet(shared(spark, ("applications", sf_dir), write))


def scored(spark, sf_dir) -> DataFrame:
    return stored(spark, sf_dir).withColumn(SCORE, p_proxy())


def decided(spark, sf_dir) -> DataFrame:
    return policy.decide(policy.add_economics(scored(spark, sf_dir)))


def labelled(df: DataFrame) -> DataFrame:
    return quality.between_dates(df, None, LABELLED_UNTIL)


def train(df: DataFrame) -> DataFrame:
    return quality.between_dates(df, None, SPLIT)


def valid(df: DataFrame) -> DataFrame:
    return quality.between_dates(df, SPLIT, LABELLED_UNTIL)


def test(df: DataFrame) -> DataFrame:
    return quality.between_dates(df, LABELLED_UNTIL, None)


# --- sources and sinks ------------------------------------------------------

@query
def applications_scan(spark, sf_dir):
    return applications(spark, sf_dir)


@query
def applications_csv(spark, sf_dir):
    path = stage_path(spark, "applications-csv")
    applications(spark, sf_dir).write.option("header", True).csv(path)
    return read_applications(spark, path)


@query
def scores_reload(spark, sf_dir):
    stored = write_stage(scored(spark, sf_dir).select(ID, TARGET, SCORE), "scores")
    return rounded(metrics.brier(stored), 9, "brier")


@query
def policy_output(spark, sf_dir):
    return rounded(policy.policy_output(decided(spark, sf_dir)), 9, "p_umbral")


@query
def predictions_output(spark, sf_dir):
    rows = test(stored(spark, sf_dir))
    path = stage_path(spark, "predictions")
    sinks.write_predictions(fitted(spark, sf_dir, 4, "logistica").score(rows), rows, path)
    written = spark.read.schema("id_solicitud long, prob_default double").option("header", True).csv(path)
    return rounded(written, 9, "prob_default")


@query
def report_json(spark, sf_dir):
    df = scored(spark, sf_dir)
    tables = reports.report_tables(labelled(df), test(df))
    path = stage_path(spark, "report")
    sinks.write_report(tables, path)
    return rounded(spark.read.schema(tables.schema).json(path), 9, "valor")


@query
def model_reload(spark, sf_dir):
    model = fitted(spark, sf_dir, 4, "logistica")
    path = stage_path(spark, "model")
    sinks.save_model(spark, model.final, model.names, path)
    rows = test(stored(spark, sf_dir))
    again = sinks.load_model(path).transform(rows).select(ID, F.col(SCORE).alias("p"))
    return model.score(rows).join(again, ID).select(ID, (F.abs(F.col(SCORE) - F.col("p")) < 1e-12).alias("igual"))


# --- projection, filters, scalar functions ----------------------------------

@query
def feature_projection(spark, sf_dir):
    return stored(spark, sf_dir).select(*feature_columns())


@query
def exclude_features(spark, sf_dir):
    return stored(spark, sf_dir).drop(LEAK, UNRELIABLE, "tasa_interes_anual")


@query
def temporal_split(spark, sf_dir):
    windows = {"train": (None, SPLIT), "valid": (SPLIT, None)}
    return quality.assign_window(stored(spark, sf_dir), windows).select(ID, "fecha_solicitud", "ventana")


@query
def rolling_window_split(spark, sf_dir):
    windows = {}
    for r in (5, 6):
        cfg = ROUNDS[r]
        windows[f"{cfg.name} train"] = (cfg.train_start, cfg.train_end)
        windows[f"{cfg.name} valid"] = (cfg.valid_start, cfg.valid_end)
    return quality.assign_window(stored(spark, sf_dir), windows).select(ID, "ventana")


@query
def split_guard(spark, sf_dir):
    return quality.split_guard(train(stored(spark, sf_dir)), 2024)


@query
def mes_solicitud(spark, sf_dir):
    return stored(spark, sf_dir).select(ID, month_label(F.col("fecha_solicitud")).alias("mes_solicitud"))


@query
def log_transform(spark, sf_dir):
    columns = ["ingreso_declarado", "deuda_sistema", "monto_solicitado"]
    logs = [F.round(F.log1p(c), 9).alias(f"log_{c}") for c in columns]
    return stored(spark, sf_dir).select(ID, *logs)


@query
def null_flags(spark, sf_dir):
    flags = {"ingreso_declarado": "flag_ingreso_declarado_nulo",
             "antiguedad_laboral_meses": "flag_antiguedad_laboral_nulo"}
    return impute.null_flags(stored(spark, sf_dir), flags).select(ID, *flags.values())


# --- data quality -----------------------------------------------------------

@query
def valid_age_median(spark, sf_dir):
    return quality.valid_age_median(train(stored(spark, sf_dir)))


def cleaned(spark, sf_dir) -> DataFrame:
    df = stored(spark, sf_dir)
    return quality.clean(df, quality.valid_age_median(train(df)).scalar())


@query
def clean_age(spark, sf_dir):
    df = stored(spark, sf_dir)
    fill = quality.valid_age_median(train(df)).scalar()
    return quality.clean_age(df, fill).select(ID, "edad", "flag_edad_inconsistente")


@query
def clean_income(spark, sf_dir):
    return quality.clean_income(stored(spark, sf_dir)).select(
        ID, "ingreso_declarado", "flag_ingreso_inconsistente")


@query
def uf_interpolate(spark, sf_dir):
    return rounded(with_rate_cap(stored(spark, sf_dir)), 6, "uf").select(ID, "fecha_solicitud", "uf")


@query
def rate_cap_lookup(spark, sf_dir):
    return rounded(with_rate_cap(stored(spark, sf_dir)), 6, "tope_tasa").select(ID, "tope_tasa")


@query
def clean_rate(spark, sf_dir):
    return rounded(quality.clean_rate(stored(spark, sf_dir)), 6, "tasa_interes_anual").select(
        ID, "tasa_interes_anual", "flag_tasa_corregida")


@query
def dq_summary(spark, sf_dir):
    windows = {"train": (None, SPLIT), "valid": (SPLIT, LABELLED_UNTIL), "test": (LABELLED_UNTIL, None)}
    return quality.quality_summary(
        quality.assign_window(cleaned(spark, sf_dir), windows, "conjunto"), ["conjunto"])


@query
def rate_cap_asof(spark, sf_dir):
    return with_rate_cap(stored(spark, sf_dir), step=True).select(ID, "tope_tasa")


def _certificates(spark):
    """The certificates: dated caps by amount band, 36 rows, each in force until the next of its band."""
    rows = [(band, dt.date.fromisoformat(day), cap) for day, *caps in RATE_CAPS for band, cap in zip(BANDS, caps)]
    listed = spark.createDataFrame(rows, "banda string, vigente_desde date, tope double")
    until = F.lead("vigente_desde").over(Window.partitionBy("banda").orderBy("vigente_desde"))
    return listed.withColumn("vigente_hasta", until)


def _banded(spark, sf_dir):
    in_uf = F.col("monto_solicitado") / F.col("uf")
    band = F.when(in_uf <= SMALL_AMOUNT_UF, BANDS[0]).when(in_uf <= MEDIUM_AMOUNT_UF, BANDS[1]).otherwise(BANDS[2])
    return with_rate_cap(stored(spark, sf_dir)).select(ID, "fecha_solicitud", band.alias("banda"))


@query
def rate_cap_in_force(spark, sf_dir):
    """The certificate in force on the day of each application, none before the first."""
    told = _certificates(spark).drop("vigente_hasta")
    return temporal.asof_join(_banded(spark, sf_dir), told, ["banda"], "fecha_solicitud", "vigente_desde").select(
        ID, "banda", "vigente_desde", F.col("tope").alias("tope_tasa"))


@query
def rate_cap_validity(spark, sf_dir):
    """The same by intervals of validity: applications in each."""
    joined = temporal.interval_join(_banded(spark, sf_dir), _certificates(spark), ["banda"], "fecha_solicitud", "vigente_desde", "vigente_hasta")
    return joined.select(ID, "banda", "vigente_desde", "vigente_hasta", F.col("tope").alias("tope_tasa"))


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query
def asof_join(spark, sf_dir):
    """Every purchase with the last error of its user before it, ties in time to the greater event."""
    events = _events(spark, sf_dir)
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    failed = events.where("event_type = 'error'").select("user_id", F.col("ts").alias("error_ts"), F.col("event_id").alias("error_id"))
    return temporal.asof_join(bought, failed, ["user_id"], "ts", "error_ts").select("event_id", "user_id", "error_id")


@query
def interval_join(spark, sf_dir):
    """Events of a user within the time after one of its errors: ten minutes for each point of the error's value."""
    events = _events(spark, sf_dir)
    spans = (events.where("event_type = 'error'")
             .select("user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("desde"),
                     (F.col("ts") + F.make_dt_interval(secs=F.floor(F.col("value") * 600))).alias("hasta")))
    return temporal.interval_join(events.select("event_id", "user_id", "ts"), spans, ["user_id"], "ts", "desde", "hasta").select(
        "event_id", "user_id", "error_id")


# --- imputation -------------------------------------------------------------

@query
def group_median_impute(spark, sf_dir):
    df = stored(spark, sf_dir)
    return impute.GroupMedianImputer().fit(train(df)).transform(df).select(ID, "ingreso_declarado")


@query
def constant_impute(spark, sf_dir):
    return impute.ConstantImputer().transform(stored(spark, sf_dir)).select(
        ID, "antiguedad_laboral_meses")


def _recipe(spark, sf_dir, name):
    columns = ["ingreso_declarado", "antiguedad_laboral_meses"]
    return rounded(impute.apply_recipe(stored(spark, sf_dir), name), 6, *columns).select(
        ID, *columns, *[f"{c}_isnull" for c in columns])


@query
def impute_median_global(spark, sf_dir):
    return _recipe(spark, sf_dir, "median_global")


@query
def impute_group_recipe(spark, sf_dir):
    return _recipe(spark, sf_dir, "group_median_tipo_empleo")


@query
def impute_knn(spark, sf_dir):
    return _recipe(spark, sf_dir, "knn")


@query
def imputation_bakeoff(spark, sf_dir):
    return bakeoff.imputation_bakeoff(labelled(stored(spark, sf_dir)))


# --- encoding ---------------------------------------------------------------

@query
def one_hot(spark, sf_dir):
    df = stored(spark, sf_dir)
    labels = {c: encode.fit_labels(train(df), c) for c in CATEGORICAL}
    names = [f"{c}_{label}" for c, values in labels.items() for label in values]
    return encode.one_hot_columns(df, labels).select(ID, *names)


def _assembled(spark, sf_dir):
    df = stored(spark, sf_dir)
    return Pipeline(stages=ROUNDS[4].feature_stages()).fit(train(df)).transform(df)


@query
def assemble_features(spark, sf_dir):
    """Long form, so that every slot can be compared by name."""
    df = _assembled(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in encode.feature_names(df)])
    slots = F.arrays_zip(names.alias("feature"), vector_to_array(encode.FEATURES).alias("valor"))
    return rounded(df.select(ID, F.explode(slots).alias("s")).select(ID, "s.*"), 6, "valor")


@query
def feature_names(spark, sf_dir):
    names = encode.feature_names(_assembled(spark, sf_dir))
    return spark.createDataFrame(list(enumerate(names)), "posicion int, feature string")


@query
def scale_no_center(spark, sf_dir):
    df = stored(spark, sf_dir)
    return rounded(encode.scale_columns(df, train(df), NUMERIC), 9, *NUMERIC).select(ID, *NUMERIC)


# --- balancing and calibration ----------------------------------------------

@query
def class_weights(spark, sf_dir):
    return rounded(balance.class_weights(train(stored(spark, sf_dir))), 9,
                   "peso_pos", "peso_neg", "scale_pos_weight")


@query
def smote_oversample(spark, sf_dir):
    frame, _, _ = trainer(spark, sf_dir, 3).resampled(0.5)
    return frame.select(ID, TARGET, vector_to_array(encode.FEATURES).alias("features"))


@query
def prior_correction_score(spark, sf_dir):
    df = scored(spark, sf_dir)
    rate = train(df).agg(F.avg(F.col(TARGET).cast("double"))).scalar()
    corrected = prior_correction(F.col(SCORE), rate, 0.5 / 1.5)
    return df.select(ID, F.round(corrected, 9).alias("p_corregida"))


QUERIES["prior_correction"] = QUERIES.pop("prior_correction_score")


@query
def hard_predict_score(spark, sf_dir):
    return scored(spark, sf_dir).select(ID, hard_predict(F.col(SCORE), 0.5).alias("prediccion"))


QUERIES["hard_predict"] = QUERIES.pop("hard_predict_score")


# --- models -----------------------------------------------------------------

def trainer(spark, sf_dir, number) -> training.Trainer:
    """Prepared fit frame of a round's training window."""
    cfg = ROUNDS[number]
    return shared(spark, ("trainer", sf_dir, number), lambda: training.Trainer(
        cfg, cfg.train(labelled(stored(spark, sf_dir)))))


def fitted(spark, sf_dir, number, family) -> training.FittedRound:
    return shared(spark, ("fitted", sf_dir, number, family), lambda: training.fit_round(
        ROUNDS[number], labelled(stored(spark, sf_dir)), family, trainer(spark, sf_dir, number)))


def _search(spark, sf_dir, number, *families):
    cfg = ROUNDS[number]
    grid = [c for family in families for c in training.candidates(cfg, family)]
    return training.search(trainer(spark, sf_dir, number), cfg.valid(labelled(stored(spark, sf_dir))), grid)


def _told(results: DataFrame) -> DataFrame:
    """Fitted candidates in their order, with their measures on the validation window."""
    return rounded(results, 9, *RATIOS).select(
        "posicion", "familia", "arquitectura", "arboles", "balanceado", "ratio", "n", "n_pos", *RATIOS).orderBy("posicion")


@query
def train_logistic(spark, sf_dir):
    return _told(fitted(spark, sf_dir, 4, "logistica").results)


@query
def train_gbt_leafwise(spark, sf_dir):
    return _told(fitted(spark, sf_dir, 1, "hojas").results)


@query
def train_gbt_depthwise(spark, sf_dir):
    return _told(fitted(spark, sf_dir, 1, "profundidad").results)


@query
def grid_smote_logit(spark, sf_dir):
    return _told(_search(spark, sf_dir, 3, "logistica"))


@query
def grid_smote_tree(spark, sf_dir):
    return _told(_search(spark, sf_dir, 3, "hojas", "profundidad"))


def _rounds_fitted(spark, sf_dir, measure, *families):
    """``measure`` of every round and family, each fitted as the round is set up and scored on its own validation window."""
    df = labelled(stored(spark, sf_dir))
    return reduce(DataFrame.unionByName, [
        reports.compare_rounds({cfg.name: measure(fitted(spark, sf_dir, number, family).score(cfg.valid(df), final=False))
                                for number, cfg in ROUNDS.items()}).withColumn("modelo", F.lit(family)) for family in families])


@query
def round_comparison_fitted(spark, sf_dir):
    """Every round fitted as it is set up, its logistic model on its own validation window."""
    table = _rounds_fitted(spark, sf_dir, metrics.eval_summary, "logistica")
    return rounded(table, 9, *RATIOS).select("ronda", "modelo", "n", "n_pos", *RATIOS)


@query
def round_comparison_boosted(spark, sf_dir):
    """Every round's two boosted models, whole grids, with their metrics."""
    table = _rounds_fitted(spark, sf_dir, metrics.eval_summary, "hojas", "profundidad")
    return rounded(table, 9, *RATIOS).select("ronda", "modelo", "n", "n_pos", *RATIOS)


# Fixed scores standing in for fitted candidates, so that selection over
# measured results can be checked exactly.
def _proxy_scores() -> list:
    p = F.col(SCORE)
    consults = F.col("num_consultas_buro_3m").cast("double")
    arrears = F.col("peor_morosidad_12m").cast("double")
    return [
        ("base", None, False, p),
        ("base", 0.5, True, F.sqrt(p)),
        ("consultas", None, False, F.least(F.lit(1.0), p + F.lit(0.02) * consults)),
        ("consultas", 0.5, False, F.least(F.lit(1.0), p + F.lit(0.02) * consults + F.lit(0.001) * arrears)),
    ]


def _proxy_results(spark, sf_dir):
    entries = [F.struct(F.lit(i).alias("posicion"), F.lit(a).alias("arquitectura"),
                        F.lit(r).cast("double").alias("ratio"), F.lit(b).alias("balanceado"), s.alias(SCORE))
               for i, (a, r, b, s) in enumerate(_proxy_scores())]
    long = scored(spark, sf_dir).select(TARGET, F.explode(F.array(*entries)).alias("e")).select(TARGET, "e.*")
    described = ["posicion", "arquitectura", "balanceado", "ratio"]
    results = metrics.eval_summary(long.withColumn("ratio", F.coalesce("ratio", F.lit(0.0))), by=described)
    return results.withColumn("ratio", F.nullif("ratio", F.lit(0.0)))


@query
def select_calibration_safe(spark, sf_dir):
    best = training.select_calibration_safe(_proxy_results(spark, sf_dir))
    return rounded(best, 9, "auc", "brier").select("posicion", "arquitectura", "auc", "brier")


@query
def select_brier_guard(spark, sf_dir):
    best = training.select_brier_guard(_proxy_results(spark, sf_dir))
    return rounded(best, 9, "auc", "brier").select("posicion", "arquitectura", "auc", "brier")


@query
def fit_oot_and_final(spark, sf_dir):
    """Scores of the model that gives honest metrics and of the one that serves, each on its rows."""
    model = fitted(spark, sf_dir, 4, "logistica")
    df = stored(spark, sf_dir)
    parts = [("oot", valid(df), False), ("final", test(df), True)]
    return reduce(DataFrame.unionByName, [
        model.score(rows, final).select(F.lit(name).alias("modelo"), ID, F.round(SCORE, 9).alias(SCORE)) for name, rows, final in parts])


@query
def score(spark, sf_dir):
    return fitted(spark, sf_dir, 4, "logistica").score(test(stored(spark, sf_dir))).select(ID, F.round(SCORE, 9).alias(SCORE))


@query
def coefficients_ranked(spark, sf_dir):
    return training.coefficients_ranked(fitted(spark, sf_dir, 4, "logistica"))


@query
def importance_ranked(spark, sf_dir):
    return training.importance_ranked(fitted(spark, sf_dir, 1, "hojas"))


# --- metrics ----------------------------------------------------------------

@query
def auc_gini(spark, sf_dir):
    return rounded(metrics.eval_summary(scored(spark, sf_dir)).select("auc", "gini"), 9, "auc", "gini")


@query
def ks_stat(spark, sf_dir):
    return rounded(metrics.eval_summary(scored(spark, sf_dir)).select("ks"), 9, "ks")


@query
def pr_auc(spark, sf_dir):
    return rounded(metrics.eval_summary(scored(spark, sf_dir)).select("pr_auc"), 9, "pr_auc")


@query
def brier(spark, sf_dir):
    return rounded(metrics.brier(scored(spark, sf_dir)), 9, "brier")


@query
def eval_summary(spark, sf_dir):
    return rounded(metrics.eval_summary(scored(spark, sf_dir)), 9, *RATIOS)


@query
def decile_table(spark, sf_dir):
    return rounded(metrics.decile_table(scored(spark, sf_dir)), 9, "avg_pred", "default_rate")


@query
def score_hist(spark, sf_dir):
    df = scored(spark, sf_dir)
    return rounded(metrics.score_hist(df, metrics.hist_max(df)), 9, "edge_lo", "edge_hi")


@query
def score_hist_by_class(spark, sf_dir):
    df = scored(spark, sf_dir)
    return rounded(metrics.score_hist(df, metrics.hist_max(df, target=TARGET), target=TARGET), 9, "edge_lo", "edge_hi")


@query
def common_hist_max(spark, sf_dir):
    windows = {"train": (None, SPLIT), "valid": (SPLIT, LABELLED_UNTIL), "test": (LABELLED_UNTIL, None)}
    df = quality.assign_window(scored(spark, sf_dir), windows)
    return rounded(metrics.common_hist_max(df, ["ventana"]), 9, "max_comun")


@query
def policy_hist(spark, sf_dir):
    df = scored(spark, sf_dir)
    return rounded(metrics.score_hist(df, metrics.hist_max(df, floor=None)), 9, "edge_lo", "edge_hi")


def _by_round(spark, sf_dir):
    """Every round's validation rows, scored by two fixed scores."""
    windows = {cfg.name: (cfg.valid_start, cfg.valid_end or LABELLED_UNTIL) for cfg in ROUNDS.values()}
    df = quality.assign_window(scored(spark, sf_dir), windows, "ronda")
    models = F.array(*[F.struct(F.lit(a).alias("modelo"), s.alias("p")) for a, r, _, s in _proxy_scores() if r is None])
    return df.withColumn("m", F.explode(models)).withColumns({"modelo": F.col("m.modelo"), SCORE: F.col("m.p")}).drop("m")


@query
def round_comparison(spark, sf_dir):
    return rounded(metrics.eval_summary(_by_round(spark, sf_dir), by=["ronda", "modelo"]), 9, *RATIOS)


# --- policy -----------------------------------------------------------------

@query
def add_economics(spark, sf_dir):
    df = policy.add_economics(stored(spark, sf_dir))
    money = ["ganancia_si_paga", "perdida_si_default"]
    return rounded(rounded(df, 4, *money), 9, "p_umbral").select(ID, *money, "p_umbral")


@query
def approve_decision(spark, sf_dir):
    return decided(spark, sf_dir).select(ID, "aprobar")


@query
def realized_value(spark, sf_dir):
    columns = ["valor_politica", "valor_aprobar_todo"]
    return rounded(policy.realized_value(decided(spark, sf_dir)), 4, *columns).select(ID, *columns)


@query
def value_breakdown(spark, sf_dir):
    return rounded(policy.value_breakdown(decided(spark, sf_dir)), 2, "monto")


@query
def gain_curve(spark, sf_dir):
    df = policy.add_economics(scored(spark, sf_dir))
    return rounded(rounded(policy.gain_curve(df), 2, "gain"), 9, "pct_approved")


@query
def threshold_table(spark, sf_dir):
    return rounded(policy.threshold_table(stored(spark, sf_dir)), 9, "p_umbral")


@query
def expected_value(spark, sf_dir):
    df = policy.expected_value(test(decided(spark, sf_dir)))
    return rounded(policy.expected_totals(df), 2, "ganancia_esperada_politica", "ganancia_esperada_aprobar_todo")


MONEY = ["ganancia_politica", "ganancia_aprobar_todo", "perdida_evitada"]


@query
def policy_eval(spark, sf_dir):
    df = policy.policy_eval(policy.realized_value(decided(spark, sf_dir)))
    return rounded(rounded(df, 2, *MONEY), 9, "pct_aprob")


@query
def policy_round_comparison(spark, sf_dir):
    df = policy.realized_value(policy.decide(policy.add_economics(_by_round(spark, sf_dir))))
    totals = reports.policy_uplift(policy.policy_eval(df, ["ronda", "modelo"]))
    return rounded(rounded(totals, 2, *MONEY), 6, "pct_aprob", "veces_aprobar_todo")


def _policy_fitted(spark, sf_dir, *families):
    table = reports.policy_uplift(_rounds_fitted(
        spark, sf_dir, lambda df: policy.policy_eval(policy.realized_value(policy.decide(policy.add_economics(df)))), *families))
    table = table.select("ronda", "modelo", *[c for c in table.columns if c not in ("ronda", "modelo")])
    return rounded(rounded(table, 2, *MONEY), 6, "pct_aprob", "veces_aprobar_todo")


@query
def policy_round_comparison_fitted(spark, sf_dir):
    """The policy over the fitted logistic model of every round, on its own validation window."""
    return _policy_fitted(spark, sf_dir, "logistica")


@query
def policy_round_comparison_boosted(spark, sf_dir):
    """The policy over the fitted boosted models of every round."""
    return _policy_fitted(spark, sf_dir, "hojas", "profundidad")


# --- exploration ------------------------------------------------------------

@query
def null_profile(spark, sf_dir):
    df = stored(spark, sf_dir)
    return rounded(eda.null_profile(df, df.columns), 9, "pct_nulos")


@query
def numeric_profile(spark, sf_dir):
    return rounded(eda.numeric_profile(stored(spark, sf_dir), NUMERIC), 6,
                   "media", "desviacion", "minimo", "q25", "mediana", "q75", "maximo")


@query
def structural_nulls(spark, sf_dir):
    df = eda.structural_nulls(stored(spark, sf_dir), "antiguedad_laboral_meses", "tipo_empleo")
    return rounded(df, 9, "pct_nulos")


@query
def weekday_mismatch(spark, sf_dir):
    return rounded(eda.weekday_mismatch(stored(spark, sf_dir)), 9, "pct_distinto")


@query
def pearson_corr(spark, sf_dir):
    return rounded(eda.pearson_corr(stored(spark, sf_dir), [*NUMERIC, TARGET]), 9, "r")


@query
def spearman_corr(spark, sf_dir):
    return rounded(eda.spearman_corr(stored(spark, sf_dir), NUMERIC), 9, "r")


@query
def vif(spark, sf_dir):
    return rounded(eda.vif(stored(spark, sf_dir), NUMERIC), 6, "vif")


def _bins(spark, sf_dir):
    df = stored(spark, sf_dir)
    return eda.quantile_bins(df, NUMERIC).unionByName(eda.category_bins(df, CATEGORICAL))


@query
def information_value(spark, sf_dir):
    return rounded(eda.information_value(_bins(spark, sf_dir)), 6, "iv")


@query
def chi_square(spark, sf_dir):
    bins = eda.category_bins(stored(spark, sf_dir), [*CATEGORICAL, UNRELIABLE])
    return rounded(eda.chi_square(bins), 6, "chi2")


@query
def cramers_v(spark, sf_dir):
    bins = eda.category_bins(stored(spark, sf_dir), [*CATEGORICAL, LEAK])
    return rounded(eda.cramers_v(bins), 6, "v_cramer")


@query
def anova_f(spark, sf_dir):
    return rounded(eda.anova_f(stored(spark, sf_dir), NUMERIC, "tipo_empleo"), 6, "f")


@query
def levene_test(spark, sf_dir):
    return rounded(eda.levene_test(stored(spark, sf_dir), NUMERIC, TARGET, few_groups=True), 6, "f")


@query
def breusch_pagan(spark, sf_dir):
    df = eda.breusch_pagan(stored(spark, sf_dir), TARGET, ["score_buro"])
    return rounded(rounded(df, 9, "r2"), 4, "lm")


@query
def significance(spark, sf_dir):
    """Every association test of the exploration with its p-value."""
    df = stored(spark, sf_dir)
    return eda.significance(df, NUMERIC, [*CATEGORICAL, UNRELIABLE], "tipo_empleo")


@query
def default_rate_by_month(spark, sf_dir):
    return rounded(eda.default_rate_by_month(scored(spark, sf_dir), SCORE), 9, "tasa_observada", "tasa_predicha")


@query
def default_drift(spark, sf_dir):
    return rounded(eda.default_drift(scored(spark, sf_dir), SCORE), 6, "z", "alza", "baja")


@query
def leakage_screen(spark, sf_dir):
    df = eda.leakage_screen(stored(spark, sf_dir), NUMERIC, CATEGORICAL)
    return rounded(df, 6, "iv", "v_cramer", "r")


# --- jobs -------------------------------------------------------------------

@query
def job_round(spark, sf_dir):
    """Out-of-time metrics of the chosen model of the chosen round."""
    model = fitted(spark, sf_dir, 4, "logistica")
    summary = metrics.eval_summary(model.score(valid(stored(spark, sf_dir)), final=False))
    return rounded(summary, 9, *RATIOS).select("n", "n_pos", *RATIOS)


@query
def job_policy(spark, sf_dir):
    """Policy tables of the chosen model: realised on labelled validation rows,
    expected on the rest."""
    model = fitted(spark, sf_dir, 4, "logistica")
    df = stored(spark, sf_dir)
    v = write_stage(model.score(valid(df), final=False), "policy-valid")
    t = write_stage(model.score(test(df)), "policy-test")
    return reports.policy_report(v, t)


@query
def policy_tables(spark, sf_dir):
    """The same tables from the fixed score."""
    df = scored(spark, sf_dir)
    tables = reports.policy_report(labelled(df), test(df))
    money = F.col("medida").isin("monto", "gain", *MONEY) | F.col("medida").startswith("ganancia_esperada")
    return tables.withColumn("valor", F.when(money, F.round("valor", 2)).otherwise(F.round("valor", 9)))


@query
def report_tables(spark, sf_dir):
    df = scored(spark, sf_dir)
    return rounded(reports.report_tables(labelled(df), test(df)), 9, "valor")


# --- streaming --------------------------------------------------------------

def _stream(spark, sf_dir, build, start=jobs.start, **options):
    """Run a stream over the applications written as files, and read its output."""
    source = stage_path(spark, "arrivals")
    stored(spark, sf_dir).write.parquet(source)
    stream = build(jobs.stream_applications(spark, source, **options))
    out, checkpoint = stage_path(spark, "stream-out"), stage_path(spark, "stream-checkpoint")
    start(stream, out, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query
def stream_score(spark, sf_dir):
    fill = quality.valid_age_median(train(stored(spark, sf_dir))).first().mediana

    def score_rows(rows):
        return quality.clean(rows, fill).withColumn(SCORE, p_proxy())

    return rounded(_stream(spark, sf_dir, lambda rows: jobs.stream_score(rows, score_rows)), 9, "p_umbral")


@query
def stream_default_rate(spark, sf_dir):
    rates = _stream(spark, sf_dir, lambda rows: jobs.stream_default_rate(rows.withColumn(SCORE, p_proxy())),
                    jobs.start_complete)
    return rounded(rates, 9, "tasa_observada", "tasa_predicha", "pct_aprob")


@query
def stream_late_rows(spark, sf_dir):
    """Default rates of closed windows, and the late rows of each, from applications that arrive out of order.

    Every tenth application arrives 150 days late, the others up to 19; a batch holds the arrivals of 90 days.
    """
    rows = scored(spark, sf_dir)
    lag = F.when(F.col(ID) % 10 == 0, 150).otherwise(F.col(ID) % 20)
    arrived = F.floor((F.datediff(DATE, F.lit("2024-01-01")) + lag) / 90)
    source, folder = stage_path(spark, "arrivals"), stage_path(spark, "monitor")
    table = write_stage(rows.withColumn("llegada", arrived), "arrivals")
    for n in [r.llegada for r in table.select("llegada").distinct().orderBy("llegada").collect()]:     # a dozen quarters
        table.where(F.col("llegada") == n).drop("llegada").write.mode("append").parquet(source)
        # what has arrived since the last start is one batch, in as many files as tasks wrote
        stream = jobs.stream_applications(spark, source, schema=rows.schema)
        jobs.start_monitor(stream, folder, f"{folder}-state", delay=30).awaitTermination()
    closed = spark.read.parquet(f"{folder}/cerrada").withColumn("estado", F.lit("cerrada"))
    late = (spark.read.parquet(f"{folder}/tarde").groupBy("desde", "hasta", "lote").agg(F.count("*").alias("n"))
            .withColumn("estado", F.lit("tarde")))
    return rounded(closed.unionByName(late, allowMissingColumns=True), 9, "tasa_observada", "tasa_predicha").select(
        "estado", F.col("lote").cast("int").alias("lote"), "desde", "hasta", "n", "tasa_observada", "tasa_predicha")
