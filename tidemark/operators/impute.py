"""Imputation with statistics learned on a fit frame."""

from __future__ import annotations

from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLWritable)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.knn import knn_mean
from tidemark.operators.quantiles import exact_median, group_median
from tidemark.session import stage_path


def null_flags(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Missing indicators, ``{column: flag name}``, present even when nothing is missing."""
    return df.withColumns({flag: F.col(c).isNull().cast("int") for c, flag in columns.items()})


class _GroupMedianParams(Params):
    valueCol = Param(Params._dummy(), "valueCol", "column to fill", TypeConverters.toString)
    groupCol = Param(Params._dummy(), "groupCol", "grouping column", TypeConverters.toString)


class GroupMedianImputer(Estimator, _GroupMedianParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fill missing values with the median of their group, learned on the fit frame."""

    @keyword_only
    def __init__(self, *, valueCol="ingreso_declarado", groupCol="tipo_empleo"):
        super().__init__()
        self._setDefault(valueCol="ingreso_declarado", groupCol="tipo_empleo")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "GroupMedianModel":
        value, group = self.getOrDefault("valueCol"), self.getOrDefault("groupCol")
        overall = exact_median(dataset, value).first().mediana
        path = stage_path(dataset.sparkSession, "medians")
        group_median(dataset, value, [group]).write.parquet(path)
        return GroupMedianModel(mediansPath=path)._set(valueCol=value, groupCol=group, overall=overall)


class _MediansWriter(DefaultParamsWriter):
    """Puts the table of medians into the model's own folder."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        model = self.instance
        model.table(self.sparkSession).write.parquet(f"{path}/medians")


class _MediansReader(DefaultParamsReader):
    def load(self, path: str) -> "GroupMedianModel":
        return super().load(path)._set(mediansPath=f"{path}/medians")


class GroupMedianModel(Model, _GroupMedianParams, MLReadable, MLWritable):
    """A value stays; else the group's median; else the overall one (an unseen
    or missing group, or a group without any value). The medians are a table,
    however many there are, and a saved model holds it."""

    mediansPath = Param(Params._dummy(), "mediansPath", "table of the group's type and its median",
                        TypeConverters.toString)
    overall = Param(Params._dummy(), "overall", "median of all values")

    @keyword_only
    def __init__(self, *, mediansPath=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def write(self) -> _MediansWriter:
        return _MediansWriter(self)

    @classmethod
    def read(cls) -> _MediansReader:
        return _MediansReader(cls)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.getOrDefault("mediansPath"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        value, group = self.getOrDefault("valueCol"), self.getOrDefault("groupCol")
        filled = F.coalesce(value, "mediana", F.lit(self.getOrDefault("overall")))
        return (dataset.join(self.table(dataset.sparkSession), group, "left")
                .withColumn(value, filled).drop("mediana")
                .select(*dataset.columns))


class ConstantImputer(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Fill missing values of one column with a constant."""

    valueCol = Param(Params._dummy(), "valueCol", "column to fill", TypeConverters.toString)
    fill = Param(Params._dummy(), "fill", "replacement", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, valueCol="antiguedad_laboral_meses", fill=0.0):
        super().__init__()
        self._setDefault(valueCol="antiguedad_laboral_meses", fill=0.0)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.fillna(self.getOrDefault("fill"), [self.getOrDefault("valueCol")])


# --- whole recipes, compared in the bake-off --------------------------------

INCOME, TENURE = "ingreso_declarado", "antiguedad_laboral_meses"
# The columns neighbours are measured on, and how many are averaged.
KNN_COLUMNS = [INCOME, TENURE, "edad", "score_buro", "monto_solicitado", "antiguedad_cliente_meses"]
KNN_NEIGHBOURS = 10
RECIPES = ["median_global", "group_median_tipo_empleo", "knn"]


def impute_median_global(df: DataFrame, fit: DataFrame | None = None) -> DataFrame:
    """Both columns filled with their overall median."""
    fit = df if fit is None else fit
    return df.withColumns({
        c: F.coalesce(F.col(c), exact_median(fit, c).scalar()) for c in (INCOME, TENURE)})


def impute_group_recipe(df: DataFrame, fit: DataFrame | None = None) -> DataFrame:
    """Income by employment type, then by the median of the column filled so
    far; tenure with 0."""
    fit = df if fit is None else fit
    medians = GroupMedianImputer().fit(fit).table(df.sparkSession)

    def by_group(frame):
        return (frame.join(medians, "tipo_empleo", "left")
                .withColumn(INCOME, F.coalesce(INCOME, "mediana")).drop("mediana"))

    rest = exact_median(by_group(fit), INCOME).scalar()
    return (by_group(df).withColumn(INCOME, F.coalesce(F.col(INCOME), rest))
            .fillna(0.0, [TENURE]).select(*df.columns))


def impute_knn(df: DataFrame, fit: DataFrame | None = None, neighbours: int = KNN_NEIGHBOURS,
               key: str = "id_solicitud") -> DataFrame:
    """Both columns filled with the mean of the nearest rows that have them."""
    fit = df if fit is None else fit
    means = knn_mean(df, fit, KNN_COLUMNS, [INCOME, TENURE], neighbours, key)
    return reduce(
        lambda frame, c: frame.withColumn(c, F.coalesce(F.col(c), F.col(f"knn_{c}"))).drop(f"knn_{c}"),
        [INCOME, TENURE], df.join(means, key, "left"))


def apply_recipe(df: DataFrame, recipe: str, fit: DataFrame | None = None) -> DataFrame:
    """One of :data:`RECIPES`, with missing indicators taken beforehand."""
    flagged = null_flags(df, {c: f"{c}_isnull" for c in (INCOME, TENURE)})
    recipes = {"median_global": impute_median_global,
               "group_median_tipo_empleo": impute_group_recipe, "knn": impute_knn}
    return recipes[recipe](flagged, fit)
