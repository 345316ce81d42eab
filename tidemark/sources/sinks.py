"""Writers for decisions, predictions, report tables and fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.policy import policy_output
from tidemark.schema import SCORE


def write_policy(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Per-application decisions, with a header and no index."""
    policy_output(df).write.option("header", True).format(fmt).save(path)


def predictions(df: DataFrame, score: str = SCORE) -> DataFrame:
    return df.select("id_solicitud", F.col(score).cast("double").alias("prob_default"))


def check_predictions(frame: DataFrame, expected: DataFrame) -> dict:
    """Fail unless there is exactly one probability in [0, 1] per expected id.

    One full outer join on the id settles missing, extra and repeated ids.
    """
    have = frame.groupBy("id_solicitud").agg(
        F.count("*").alias("veces"),
        F.count_if(~F.coalesce(F.col("prob_default").between(0, 1), F.lit(False))).alias("malas"))
    want = expected.select("id_solicitud").distinct().withColumn("esperado", F.lit(True))
    found = have.join(want, "id_solicitud", "full").agg(
        F.count_if(F.col("veces").isNull()).alias("faltan"),
        F.count_if(F.col("esperado").isNull()).alias("sobran"),
        F.count_if(F.col("veces") > 1).alias("repetidas"),
        F.coalesce(F.sum("malas"), F.lit(0)).alias("fuera_de_rango"),
        F.count_if("esperado").alias("n")).first().asDict()
    problems = {k: v for k, v in found.items() if k != "n" and v}
    if problems:
        raise ValueError(f"predictions are not usable: {problems}")
    return found


def write_predictions(df: DataFrame, expected: DataFrame, path: str, fmt: str = "csv") -> None:
    frame = predictions(df)
    check_predictions(frame, expected)
    frame.write.option("header", True).format(fmt).save(path)


def write_report(tables: DataFrame, path: str, fmt: str = "json") -> None:
    """Long-form report tables; JSON lines by default."""
    tables.write.format(fmt).save(path)


def save_model(spark: SparkSession, model: PipelineModel, names: list[str], path: str) -> None:
    """The fitted stages with their learned values, and the feature names."""
    model.write().overwrite().save(f"{path}/model")
    rows = list(enumerate(names))
    spark.createDataFrame(rows, "posicion int, feature string").write.mode("overwrite").parquet(f"{path}/features")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")
