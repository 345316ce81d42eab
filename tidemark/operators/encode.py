"""Feature encoding, assembly and scaling as Spark ML stages."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import month_label
from tidemark.operators import quality
from tidemark.operators.impute import ConstantImputer, GroupMedianImputer
from tidemark.schema import CATEGORICAL, DATE, LOGGED, PLAIN

FEATURES = "features"
SCALED = "scaled"
MAX_LABELS = 10_000       # a label is a feature slot, so there cannot be many


class QualityCorrector(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the median valid age; the model applies all corrections."""

    def _fit(self, dataset: DataFrame) -> "QualityModel":
        return QualityModel(ageFill=quality.valid_age_median(dataset).first().mediana)


class QualityModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    ageFill = Param(Params._dummy(), "ageFill", "age put in place of impossible ones",
                    TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, ageFill=None):
        super().__init__()
        if ageFill is not None:
            self._set(ageFill=ageFill)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return quality.clean(dataset, self.getOrDefault("ageFill"))


class MonthLabel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Calendar month as a category."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("mes_solicitud", month_label(F.col(DATE)))


class NoCenterScaler(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Divide each slot by its population deviation, leave constant slots as
    they are, and do not centre. The fitted stage is an ElementwiseProduct."""

    @keyword_only
    def __init__(self, *, inputCol=FEATURES, outputCol=SCALED):
        super().__init__()
        self._setDefault(inputCol=FEATURES, outputCol=SCALED)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ElementwiseProduct:
        column = F.col(self.getInputCol())
        row = dataset.select(Summarizer.metrics("variance", "count").summary(column).alias("s")).first().s
        n = row["count"]
        population = row["variance"].toArray() * (n - 1) / n
        factors = [1.0 / v ** 0.5 if v > 0 else 1.0 for v in population]
        return ElementwiseProduct(scalingVec=Vectors.dense(factors), inputCol=self.getInputCol(),
                                  outputCol=self.getOutputCol())


def log_stage(columns: list[str]) -> SQLTransformer:
    """Add ``log_<column>`` for each column; negatives of one or less give null."""
    return SQLTransformer(statement="SELECT *, " + ", ".join(
        f"log1p({c}) AS log_{c}" for c in columns) + " FROM __THIS__")


def one_hot_stages(categorical: list[str]) -> list:
    """Labels are alphabetical and all keep a slot: the dropped last slot is
    the bucket of unseen labels, which therefore encode as zeros."""
    index = StringIndexer(inputCols=categorical, outputCols=[f"ix_{c}" for c in categorical],
                          stringOrderType="alphabetAsc", handleInvalid="keep")
    return [index, OneHotEncoder(inputCols=index.getOutputCols(), dropLast=True,
                                 outputCols=[f"oh_{c}" for c in categorical])]


def assemble_stage(numeric: list[str], categorical: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=numeric + [f"oh_{c}" for c in categorical], outputCol=FEATURES)


def encoding_stages(plain=PLAIN, categorical=CATEGORICAL, income_flag: str = "flag_ingreso_declarado_nulo") -> list:
    """Missing flags, imputation, logs, one-hot slots, and their assembly.

    Flags are taken before imputation.
    """
    tenure_flag = "flag_antiguedad_laboral_nulo"
    flags = SQLTransformer(statement=f"""
        SELECT *, CAST(ingreso_declarado IS NULL AS INT) AS {income_flag},
               CAST(antiguedad_laboral_meses IS NULL AS INT) AS {tenure_flag}
        FROM __THIS__""")
    numeric = [income_flag, tenure_flag, "log_ingreso_declarado", "antiguedad_laboral_meses",
               *[f"log_{c}" for c in LOGGED], *plain]
    return [flags, GroupMedianImputer(), ConstantImputer(), log_stage(["ingreso_declarado", *LOGGED]),
            *one_hot_stages(categorical), assemble_stage(numeric, categorical)]


def feature_names(assembled: DataFrame, column: str = FEATURES) -> list[str]:
    """Slot names in order, from the column's ML attributes."""
    groups = assembled.schema[column].metadata["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a["name"]) for group in groups.values() for a in group)
    return [name.removeprefix("oh_") for _, name in slots]


def fit_labels(fit: DataFrame, column: str) -> list[str]:
    """Alphabetical labels seen in the fit frame."""
    rows = (fit.where(F.col(column).isNotNull()).groupBy(column).count()
            .select(column).limit(MAX_LABELS + 1).collect())
    if len(rows) > MAX_LABELS:
        raise ValueError(f"{column} has over {MAX_LABELS} labels; one slot each is not feasible")
    return sorted(r[0] for r in rows)


def one_hot_columns(df: DataFrame, labels: dict[str, list[str]]) -> DataFrame:
    """The one-hot slots as 0/1 columns; unseen and missing labels give zeros."""
    return df.withColumns({
        f"{c}_{label}": F.coalesce((F.col(c) == label).cast("int"), F.lit(0))
        for c, values in labels.items() for label in values})


def scale_columns(df: DataFrame, fit: DataFrame, columns: list[str]) -> DataFrame:
    """Column form of :class:`NoCenterScaler`."""
    deviations = fit.agg(F.struct(*[F.stddev_pop(c).alias(c) for c in columns]).alias("s")).scalar()
    return df.withColumn("__s", deviations).withColumns({
        c: F.col(c) / F.coalesce(F.nullif(F.col(f"__s.{c}"), F.lit(0.0)), F.lit(1.0)) for c in columns
    }).drop("__s")
