"""Candidate search, selection, refit and scoring."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from itertools import chain
from multiprocessing.pool import ThreadPool
from threading import Lock

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml.wrapper import JavaParams
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.probability import prior_correction
from tidemark.operators import boosting, logistic
from tidemark.operators.balance import MinoritySpace, class_weights, with_weight
from tidemark.operators.encode import FEATURES, SCALED, NoCenterScaler, feature_names
from tidemark.operators.metrics import eval_summary
from tidemark.operators.quality import split_guard
from tidemark.plans.rounds import SMOTE_RATIOS, RoundConfig
from tidemark.schema import ID, SCORE, TARGET
from tidemark.session import exists, ledger, mark, spread, stage_path, write_stage

BRIER_TOLERANCE = 1.10
PARALLEL_FITS = 8
#: Rows a task of a boosted fit gets. A tree is some jobs deep: on a small frame, many tasks cost more than their rows do.
TASK_ROWS = 64_000
#: Rows up to which a boosted fit is one task (some 150 MB); beyond them, Spark's own fit spreads the rows.
BOOST_ROWS = 1 << 20
#: Saves of models side by side have failed with "Cannot parse null string"; one at a time is quick enough.
SAVING = Lock()
#: Written into the folder of a kept fit when it is whole.
DONE = "_FITTED"

# The boosting settings tried, leaf-wise and depth-wise.
LEAFWISE_GRID = [
    {"num_leaves": 15, "learning_rate": 0.05, "n_estimators": 300, "min_child_samples": 30},
    {"num_leaves": 15, "learning_rate": 0.05, "n_estimators": 300, "min_child_samples": 30, "balanced": True},
    {"num_leaves": 31, "learning_rate": 0.05, "n_estimators": 300, "min_child_samples": 30},
    {"num_leaves": 31, "learning_rate": 0.05, "n_estimators": 500, "min_child_samples": 50},
    {"num_leaves": 31, "learning_rate": 0.1, "n_estimators": 200, "min_child_samples": 50},
    {"num_leaves": 63, "learning_rate": 0.05, "n_estimators": 300, "min_child_samples": 20},
    {"num_leaves": 31, "learning_rate": 0.05, "n_estimators": 300, "min_child_samples": 100},
    {"num_leaves": 31, "learning_rate": 0.02, "n_estimators": 800, "min_child_samples": 50},
]
DEPTHWISE_GRID = [
    {"max_depth": 3, "learning_rate": 0.05, "n_estimators": 300, "min_child_weight": 5},
    {"max_depth": 3, "learning_rate": 0.05, "n_estimators": 300, "min_child_weight": 5, "balanced": True},
    {"max_depth": 4, "learning_rate": 0.05, "n_estimators": 300, "min_child_weight": 5},
    {"max_depth": 4, "learning_rate": 0.05, "n_estimators": 500, "min_child_weight": 10},
    {"max_depth": 4, "learning_rate": 0.1, "n_estimators": 200, "min_child_weight": 10},
    {"max_depth": 6, "learning_rate": 0.05, "n_estimators": 300, "min_child_weight": 3},
    {"max_depth": 4, "learning_rate": 0.05, "n_estimators": 300, "min_child_weight": 20},
    {"max_depth": 4, "learning_rate": 0.02, "n_estimators": 800, "min_child_weight": 10},
]
LEAFWISE_SMOTE_ARCHITECTURES = [
    {"num_leaves": 15, "learning_rate": 0.05, "n_estimators": 300, "min_child_samples": 30},
    {"num_leaves": 31, "learning_rate": 0.05, "n_estimators": 300, "min_child_samples": 30},
]
DEPTHWISE_SMOTE_ARCHITECTURES = [
    {"max_depth": 3, "learning_rate": 0.05, "n_estimators": 300, "min_child_weight": 5},
    {"max_depth": 4, "learning_rate": 0.05, "n_estimators": 300, "min_child_weight": 5},
]


@dataclass(frozen=True)
class Candidate:
    """One setting of one family; ``ratio`` is the oversampling ratio."""

    family: str
    settings: tuple[tuple[str, float], ...]
    balanced: bool = False
    ratio: float | None = None

    @property
    def architecture(self) -> str:
        return self.family + " " + " ".join(f"{k}={v}" for k, v in self.settings)


def candidates(cfg: RoundConfig, family: str) -> list[Candidate]:
    """The grid a round searches for a family, in its order."""
    if family == "logistica":
        grid = [{"C": c} for c in cfg.logit_c]
        if not cfg.smote:
            grid = [{**g, "balanced": b} for g in grid for b in (False, True)]
    elif family == "hojas":
        grid = LEAFWISE_SMOTE_ARCHITECTURES if cfg.smote else LEAFWISE_GRID
    elif family == "profundidad":
        grid = DEPTHWISE_SMOTE_ARCHITECTURES if cfg.smote else DEPTHWISE_GRID
    else:
        raise ValueError(f"unknown model family {family}")
    ratios = SMOTE_RATIOS if cfg.smote else [None]
    return [Candidate(family, tuple((k, v) for k, v in g.items() if k != "balanced"),
                      g.get("balanced", False), r) for g in grid for r in ratios]


class ProbabilityColumn(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Default probability as a plain column, brought back to the true rate
    when the model was trained at another one."""

    source = Param(Params._dummy(), "source", "probability vector", TypeConverters.toString)
    output = Param(Params._dummy(), "output", "score column", TypeConverters.toString)
    trueRate = Param(Params._dummy(), "trueRate", "default rate in the data", TypeConverters.toFloat)
    trainedRate = Param(Params._dummy(), "trainedRate", "default rate trained on", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, source="probability", output=SCORE, trueRate=None, trainedRate=None):
        super().__init__()
        self._setDefault(source="probability", output=SCORE)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        score = vector_to_array(F.col(self.getOrDefault("source")))[1]
        if self.isSet("trueRate"):
            score = prior_correction(score, self.getOrDefault("trueRate"), self.getOrDefault("trainedRate"))
        return dataset.withColumn(self.getOrDefault("output"), score)


class Trainer:
    """Fits candidates on one prepared fit frame.

    The feature stages are fitted once and the assembled frame is written once;
    every candidate then reads that table.
    """

    def __init__(self, cfg: RoundConfig, fit: DataFrame):
        self.cfg = cfg
        self.features: PipelineModel = Pipeline(stages=cfg.feature_stages()).fit(fit)
        prepared = self.features.transform(fit)
        self.names = feature_names(prepared)
        self.frame = write_stage(spread(prepared.select(ID, TARGET, FEATURES), ID), "fit-frame")
        sizes = class_weights(self.frame).first()
        self.weights = {"logistica": (sizes.peso_pos, sizes.peso_neg)}
        self.boost_weights = (sizes.scale_pos_weight, 1.0)
        self.true_rate = sizes.n_pos / sizes.n
        self._resampled: dict = {}
        self._solved: dict[Candidate, list[Transformer]] = {}
        self._space: MinoritySpace | None = None
        self._state: tuple | None = None

    def resampled(self, ratio: float | None) -> tuple[DataFrame, int, float]:
        """Fit frame at a ratio, its size and its default rate."""
        if ratio not in self._resampled:
            frame = self.frame
            if ratio is not None:
                self._space = self._space or MinoritySpace(self.frame)
                # only the new rows are stored; the fit frame is a table already
                frame = frame.unionByName(write_stage(self._space.synthetic(ratio), "synthetic"))
            n, pos = frame.agg(F.count("*"), F.sum(TARGET)).first()
            self._resampled[ratio] = (frame, n, pos / n)
        return self._resampled[ratio]

    def known(self, candidate: Candidate) -> str | None:
        """Where the ledger keeps the fit of this candidate on this frame, if it does."""
        path = self._place(candidate)
        return path if exists(self.frame.sparkSession, f"{path}/{DONE}") else None

    def _place(self, candidate: Candidate) -> str:
        if self._state is None:
            row = F.xxhash64(ID, TARGET, vector_to_array(FEATURES))
            self._state = tuple(self.frame.agg(F.count("*"), F.bit_xor(row), F.sum(row % 1_000_003)).first())
        key = repr((self._state, self.names, candidate))
        return f"{ledger(self.frame.sparkSession)}/{hashlib.sha256(key.encode()).hexdigest()}"

    def fit(self, candidate: Candidate, suffix: str = "") -> list[Transformer]:
        """Fitted stages from the assembled vector to ``p_default<suffix>``.

        Fits are kept in a ledger in the shared folder, under the state of the frame and the settings, so that a search
        that was cut short, or another query, fits only what is missing.
        """
        path = self.known(candidate)
        if path is None:
            stages, path = self.fit_new(candidate), self._place(candidate)
            with SAVING:
                PipelineModel(stages).write().overwrite().save(path)
            mark(self.frame.sparkSession, f"{path}/{DONE}")     # last, so a fit that is found is whole
        else:
            stages = PipelineModel.load(path).stages
        return renamed(stages, suffix)

    def fit_new(self, candidate: Candidate) -> list[Transformer]:
        frame, n, trained_rate = self.resampled(candidate.ratio)
        settings = dict(candidate.settings)
        stages: list[Transformer] = []
        if candidate.family == "logistica" and 0 < trained_rate < 1:
            if candidate not in self._solved:
                self.solve([candidate])
            stages += self._solved[candidate]
        elif candidate in self._solved:         # by `boost`
            stages += self._solved[candidate]
        else:
            if candidate.family == "logistica":         # one class only: no minimum, and Spark's own answer to that
                stages.append(NoCenterScaler(outputCol=SCALED).fit(frame))
                learner = LogisticRegression(
                    featuresCol=SCALED, regParam=1.0 / (settings["C"] * n), elasticNetParam=0.0,
                    standardization=False, maxIter=3000, tol=1e-6, family="binomial")
            else:
                learner = self.booster(candidate)
                frame = frame.coalesce(max(2, math.ceil(n / TASK_ROWS)))
            learner.setLabelCol(TARGET).setPredictionCol("prediction")
            learner.setProbabilityCol("probability").setRawPredictionCol("raw")
            if candidate.balanced:
                weights = self.weights.get(candidate.family, self.boost_weights)
                frame = with_weight(frame, *weights)
                learner.setWeightCol("peso")
            for stage in stages:
                frame = stage.transform(frame)
            stages.append(learner.fit(frame))
        rates = {} if candidate.ratio is None else {
            "trueRate": self.true_rate, "trainedRate": trained_rate}
        stages.append(ProbabilityColumn(source="probability", output=SCORE, **rates))
        return stages

    def solve(self, grid: list[Candidate]) -> None:
        """Fit the logistic candidates among ``grid`` that share a frame in the same passes over it."""
        grid = [c for c in grid if c.family == "logistica" and c not in self._solved]
        for ratio in dict.fromkeys(c.ratio for c in grid):
            frame, _, trained_rate = self.resampled(ratio)
            if not 0 < trained_rate < 1:
                continue
            scaler = NoCenterScaler(outputCol=SCALED).fit(frame)
            asked = [c for c in grid if c.ratio == ratio]
            settings = [logistic.Setting(1.0 / dict(c.settings)["C"], *(self.weights["logistica"] if c.balanced else (1.0, 1.0)))
                        for c in asked]
            logistic.fit(frame, FEATURES, TARGET, ID, scaler.getScalingVec().toArray(), settings)
            for c, s in zip(asked, settings):
                self._solved[c] = [scaler, logistic_model(s.w)]

    def booster(self, candidate: Candidate) -> GBTClassifier:
        """Depth-wise boosting. A tree of L leaves is given depth log2(L); a
        least Hessian weight w needs at least 4 w rows, as p (1 - p) <= 1/4."""
        settings = dict(candidate.settings)
        if "num_leaves" in settings:
            depth, rows = round(math.log2(settings["num_leaves"] + 1)), settings["min_child_samples"]
        else:
            depth, rows = settings["max_depth"], 4 * settings["min_child_weight"]
        return GBTClassifier(featuresCol=FEATURES, maxIter=settings["n_estimators"], maxDepth=depth, minInstancesPerNode=rows,
                             stepSize=settings["learning_rate"], seed=42)

    def model(self, candidate: Candidate, fitted: list[Transformer] | None = None) -> PipelineModel:
        """From raw applications to ``p_default``; what is saved and served.

        ``fitted``: stages that a search has fitted on this frame already.
        """
        if not fitted and not self.known(candidate):
            boost([(self, candidate)])
        return PipelineModel(self.features.stages + (renamed(fitted) if fitted else self.fit(candidate)))


def logistic_model(w) -> LogisticRegressionModel:
    """Spark's model of an intercept and coefficients."""
    uid = f"LogisticRegression_{uuid.uuid4().hex[:12]}"
    model = LogisticRegressionModel(JavaParams._new_java_obj(
        "org.apache.spark.ml.classification.LogisticRegressionModel", uid, Vectors.dense(w[1:]), float(w[0])))
    return model.setFeaturesCol(SCALED).setPredictionCol("prediction").setProbabilityCol("probability").setRawPredictionCol("raw")


def boost(asked: list[tuple[Trainer, Candidate]]) -> None:
    """Fit the boosted candidates whose frames a task can hold, each in a task of its own, all in one job."""
    asked = [(t, c) for t, c in asked if c.family != "logistica" and c not in t._solved and 0 < t.resampled(c.ratio)[1] <= BOOST_ROWS]
    if not asked:
        return
    asked.sort(key=lambda item: -dict(item[1].settings)["n_estimators"] * item[0].resampled(item[1].ratio)[1])     # the longest first
    places = list(dict.fromkeys((id(t), c.ratio) for t, c in asked))
    frames = [next(t.resampled(r)[0] for t, _ in asked if id(t) == i) for i, r in places]
    learners = [t.booster(c) for t, c in asked]
    settings = [boosting.Setting(places.index((id(t), c.ratio)), learner.getMaxIter(), learner.getMaxDepth(), learner.getMinInstancesPerNode(),
                                 learner.getStepSize(), t.boost_weights if c.balanced else None) for (t, c), learner in zip(asked, learners)]
    nodes = boosting.fit(frames, FEATURES, TARGET, settings)
    for (_, c), learner in zip(asked, learners):
        learner.setLabelCol(TARGET).setPredictionCol("prediction").setProbabilityCol("probability").setRawPredictionCol("raw")
        if c.balanced:
            learner.setWeightCol("peso")
    with ThreadPool(PARALLEL_FITS) as pool:
        build = inheritable_thread_target(nodes.sparkSession)(
            lambda i: boosted_model(learners[i], nodes.where(F.col("setting") == i), len(asked[i][0].names)))
        for (t, c), model in zip(asked, pool.map(build, range(len(asked)), chunksize=1)):
            t._solved[c] = [model]


def boosted_model(learner: GBTClassifier, nodes: DataFrame, features: int) -> GBTClassificationModel:
    """Spark's model of fitted trees, by way of the files that Spark saves one in."""
    spark, path = nodes.sparkSession, stage_path(nodes.sparkSession, "boosted")
    with SAVING:
        learner.write().save(f"{path}-learner")
    told = json.loads(spark.read.text(f"{path}-learner/metadata").first()[0])
    trees = learner.getMaxIter()
    told |= {"class": "org.apache.spark.ml.classification.GBTClassificationModel", "numFeatures": features, "numTrees": trees}
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    tree = {k: told[k] for k in ("timestamp", "sparkVersion")} | {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "defaultParamMap": {
        k: told["defaultParamMap"][k] for k in ("cacheNodeIds", "checkpointInterval", "featuresCol", "labelCol", "leafCol", "maxBins", "maxDepth", "maxMemoryInMB",
                                                "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed")} | {"impurity": "variance"},
        "paramMap": {k: v for k, v in told["paramMap"].items() if k in ("featuresCol", "labelCol", "maxDepth", "minInstancesPerNode", "predictionCol", "seed", "weightCol")}}
    rows = [(i, json.dumps(tree | {"uid": f"dtr_{uuid.uuid4().hex[:12]}"}), learner.getStepSize() if i else 1.0) for i in range(trees)]
    spark.createDataFrame(rows, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    nodes.select("treeID", "nodeData").write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)


def renamed(stages: list[Transformer], suffix: str = "") -> list[Transformer]:
    """Fitted stages with the column names of a single model, or those of one of a search."""
    out = [stage.copy() for stage in stages]
    learner, last = out[-2], out[-1]
    if len(out) == 3:
        out[0].setOutputCol(f"{SCALED}{suffix}")
        learner.setFeaturesCol(f"{SCALED}{suffix}")
    learner.setPredictionCol(f"prediction{suffix}").setProbabilityCol(f"probability{suffix}").setRawPredictionCol(f"raw{suffix}")
    last._set(source=f"probability{suffix}", output=f"{SCORE}{suffix}")
    return out


def search(trainer: Trainer, valid: DataFrame, grid: list[Candidate]) -> DataFrame:
    """The results of `search_fits` without the fitted stages."""
    return search_fits(trainer, valid, grid)[0]


def search_fits(trainer: Trainer, valid: DataFrame, grid: list[Candidate]) -> tuple[DataFrame, list[list[Transformer]]]:
    """Fit every candidate and measure all of them on the validation window.

    The validation rows are prepared once, all models add their score side by
    side in one pass, and one grouped job measures every candidate. ``arboles``
    is the number of trees that were fitted.
    """
    scored = trainer.features.transform(valid).select(ID, TARGET, FEATURES)
    missing = [c for c in grid if not trainer.known(c)]
    for ratio in {c.ratio for c in missing}:
        trainer.resampled(ratio)
    trainer.solve(missing)
    boost([(trainer, c) for c in missing])
    # independent fits share the cluster; the driver only submits their jobs
    with ThreadPool(PARALLEL_FITS) as pool:
        fit = inheritable_thread_target(scored.sparkSession)(
            lambda item: trainer.fit(item[1], f"_{item[0]}"))
        fits = pool.map(fit, enumerate(grid), chunksize=1)
    for stage in chain.from_iterable(fits):
        scored = stage.transform(scored)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(i).alias("posicion"), F.col(f"{SCORE}_{i}").alias(SCORE)) for i in range(len(grid))]))
    long = write_stage(scored.select(TARGET, pairs.alias("c")).select(TARGET, "c.*"), "candidate-scores")
    metrics = eval_summary(long, by=["posicion"])
    trees = [getattr(stages[-2], "getNumTrees", None) for stages in fits]
    described = scored.sparkSession.createDataFrame(
        [(i, c.family, c.architecture, t, c.balanced, c.ratio) for i, (c, t) in enumerate(zip(grid, trees))],
        "posicion int, familia string, arquitectura string, arboles int, balanceado boolean, ratio double")
    return described.join(metrics, "posicion"), fits


def select_calibration_safe(results: DataFrame, by=()) -> DataFrame:
    """Highest AUC among unweighted candidates; the earlier one on a tie."""
    order = Window.partitionBy(*by).orderBy(F.desc("auc"), "posicion")
    return (results.where(~F.col("balanceado"))
            .withColumn("lugar", F.row_number().over(order)).where("lugar = 1").drop("lugar"))


def select_brier_guard(results: DataFrame, by=()) -> DataFrame:
    """Highest AUC among candidates whose Brier stays within 10 % of the
    candidate of the same architecture trained without oversampling."""
    baseline = results.where(F.col("ratio").isNull()).select(
        *by, "arquitectura", F.col("brier").alias("brier_base"))
    order = Window.partitionBy(*by).orderBy(F.desc("auc"), "posicion")
    return (results.join(baseline, [*by, "arquitectura"])
            .where(F.col("brier") <= F.col("brier_base") * BRIER_TOLERANCE)
            .withColumn("lugar", F.row_number().over(order)).where("lugar = 1").drop("lugar"))


def select_best(cfg: RoundConfig, family: str, results: DataFrame) -> DataFrame:
    """The rule each round uses: the guard protects boosted trees from
    oversampling; corrected logistic scores need none."""
    if cfg.smote and family != "logistica":
        return select_brier_guard(results)
    return select_calibration_safe(results)


@dataclass
class FittedRound:
    """``oot`` is fitted on the training window and gives honest metrics;
    ``final`` scores new applications, and is fitted when it is first asked for."""

    cfg: RoundConfig
    family: str
    results: DataFrame
    chosen: Candidate
    oot: PipelineModel
    last: Callable[[], Trainer]

    @cached_property
    def _last(self) -> Trainer:
        return self.last()

    @cached_property
    def final(self) -> PipelineModel:
        return self._last.model(self.chosen) if self.cfg.refit else self.oot

    @property
    def names(self) -> list[str]:
        return self._last.names

    def score(self, df: DataFrame, final: bool = True) -> DataFrame:
        columns = df.columns
        scored = (self.final if final else self.oot).transform(df)
        # decisions use the requested amounts and terms as they came in
        return scored.select(*[c for c in columns if c in scored.columns], SCORE)


def check_split(cfg: RoundConfig, labelled: DataFrame) -> None:
    """Fails when rows of the training window are dated past the year it ends in."""
    if cfg.train_end:
        last = dt.date.fromisoformat(cfg.train_end) - dt.timedelta(days=1)
        split_guard(cfg.train(labelled), last.year).collect()


def fit_round(cfg: RoundConfig, labelled: DataFrame, family: str = "logistica",
              trainer: Trainer | None = None, grid: list[Candidate] | None = None) -> FittedRound:
    """Search on the windows, then refit on every labelled row if the round
    does. A trainer of the training window may be passed in to share its frame,
    and a grid in place of the round's own. The windows must not overlap."""
    check_split(cfg, labelled)
    trainer = trainer or Trainer(cfg, cfg.train(labelled))
    grid = grid or candidates(cfg, family)
    results, fits = search_fits(trainer, cfg.valid(labelled), grid)
    results = write_stage(results, "search")
    best = select_best(cfg, family, results).first().posicion
    chosen, oot = grid[best], trainer.model(grid[best], fits[best])
    return FittedRound(cfg, family, results, chosen, oot, lambda: Trainer(cfg, labelled) if cfg.refit else trainer)


def coefficients_ranked(fitted: FittedRound) -> DataFrame:
    """Coefficients of the final logistic model, largest magnitude first."""
    learner = fitted.final.stages[-2]
    rows = list(zip(fitted.names, map(float, learner.coefficients)))
    return fitted.results.sparkSession.createDataFrame(
        rows, "feature string, coef double").orderBy(F.desc(F.abs("coef")))


def node_splits(nodes: DataFrame) -> DataFrame:
    """How often each feature splits a node, from the node table of a saved ensemble: position, splits."""
    split = F.col("nodeData.split.featureIndex").alias("position")
    return nodes.where("nodeData.leftChild >= 0").select(split).groupBy("position").agg(F.count("*").alias("splits"))


def importance_ranked(fitted: FittedRound) -> DataFrame:
    """Importances of the final boosted trees: nodes split by each feature, and its share of the gain.

    Most splits first, then by name.
    """
    spark, learner = fitted.results.sparkSession, fitted.final.stages[-2]
    path = stage_path(spark, "ensemble")
    learner.write().save(path)
    rows = [(i, name, float(gain)) for i, (name, gain) in enumerate(zip(fitted.names, learner.featureImportances.toArray()))]
    listed = spark.createDataFrame(rows, "position int, feature string, importance double")
    return (listed.join(node_splits(spark.read.parquet(f"{path}/data")), "position", "left")
            .select("feature", F.coalesce("splits", F.lit(0).cast("long")).alias("splits"), "importance")
            .orderBy(F.desc("splits"), "feature"))
