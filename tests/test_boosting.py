"""Boosted fits of a task equal those of Spark's own learner."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.operators.balance import with_weight
from tidemark.plans.training import boosted_model


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        a, b, kind = rng.gauss(0, 1), rng.randint(0, 6), rng.choice("xyz")
        rows.append((i, a, float(b), rng.random(), kind, int(a + 0.4 * b + (kind == "x") + rng.gauss(0, 1) > 2)))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, kind string, y int")
    stages = [StringIndexer(inputCol="kind", outputCol="ix"), OneHotEncoder(inputCol="ix", outputCol="oh", dropLast=False),
              VectorAssembler(inputCols=["a", "b", "c", "oh"], outputCol="features")]
    return Pipeline(stages=stages).fit(df).transform(df).select("id", "y", "features").coalesce(2).cache()


def learner(depth, least, rate):
    return GBTClassifier(featuresCol="features", labelCol="y", maxIter=12, maxDepth=depth, minInstancesPerNode=least, stepSize=rate, seed=42).setRawPredictionCol("raw")


def test_fits_equal_those_of_spark(frame):
    learners = [learner(3, 20, 0.3), learner(5, 8, 0.1), learner(4, 15, 0.2)]
    weights = [None, None, (3.5, 1.0)]
    settings = [boosting.Setting(0, 12, x.getMaxDepth(), x.getMinInstancesPerNode(), x.getStepSize(), w) for x, w in zip(learners, weights)]
    nodes = boosting.fit([frame], "features", "y", settings)
    for i, (x, w) in enumerate(zip(learners, weights)):
        other = x.fit(frame) if w is None else x.copy().setWeightCol("peso").fit(with_weight(frame.withColumnRenamed("y", "default_12m"), *w).withColumnRenamed("default_12m", "y"))
        model = boosted_model(x, nodes.where(F.col("setting") == i), 6)
        assert model.getNumTrees == other.getNumTrees == 12
        got = [np.array([r[0] for r in m.transform(frame).orderBy("id").select(vector_to_array("raw")[1]).collect()]) for m in (model, other)]
        np.testing.assert_allclose(got[0], got[1], atol=1e-9)
        np.testing.assert_allclose(model.featureImportances.toArray(), other.featureImportances.toArray(), atol=1e-9)


def test_one_class_and_few_rows(spark, frame):
    one = frame.where("y = 1 AND id < 50")
    nodes = boosting.fit([one, frame.where("id = 0")], "features", "y", [boosting.Setting(0, 2, 3, 1, 0.1), boosting.Setting(1, 2, 3, 1, 0.1)])
    assert [tuple(r) for r in nodes.groupBy("setting", "treeID").count().orderBy("setting", "treeID").collect()] == [(0, 0, 1), (0, 1, 1), (1, 0, 1), (1, 1, 1)]
