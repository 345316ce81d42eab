"""Corrections of impossible ages, mis-scaled incomes and illegal rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import with_rate_cap
from tidemark.operators.quantiles import exact_median
from tidemark.schema import DATE, MONTH, QUALITY_FLAGS

MIN_AGE, MAX_AGE = 18, 100
INCOME_FLOOR = 200_000


def _mask(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def valid_age_median(fit: DataFrame) -> DataFrame:
    """Median valid age of the fit window, one row ``mediana``."""
    return exact_median(fit.where(F.col("edad").between(MIN_AGE, MAX_AGE)), "edad")


def clean_age(df: DataFrame, fill: Column | float) -> DataFrame:
    fill = fill if isinstance(fill, Column) else F.lit(float(fill))
    wrong = _mask((F.col("edad") < MIN_AGE) | (F.col("edad") > MAX_AGE))
    return (df.withColumn("flag_edad_inconsistente", wrong.cast("int"))
              .withColumn("edad", F.when(wrong, fill).otherwise(F.col("edad").cast("double"))))


def clean_income(df: DataFrame) -> DataFrame:
    """Incomes at or under the floor become missing and are imputed later."""
    wrong = _mask(F.col("ingreso_declarado") <= INCOME_FLOOR)
    return (df.withColumn("flag_ingreso_inconsistente", wrong.cast("int"))
              .withColumn("ingreso_declarado", F.when(~wrong, F.col("ingreso_declarado"))))


def clean_rate(df: DataFrame, step: bool = False) -> DataFrame:
    """Cap the rate at the legal maximum for its day and amount."""
    capped = with_rate_cap(df, step=step)
    wrong = _mask(F.col("tasa_interes_anual") > F.col("tope_tasa"))
    return (capped.withColumn("flag_tasa_corregida", wrong.cast("int"))
                  .withColumn("tasa_interes_anual", F.when(wrong, F.col("tope_tasa"))
                              .otherwise(F.col("tasa_interes_anual")))
                  .drop("uf", "tope_tasa"))


def clean(df: DataFrame, age_fill: Column | float) -> DataFrame:
    """All three corrections. ``age_fill`` comes from the fit window."""
    return clean_rate(clean_income(clean_age(df, age_fill)))


def quality_summary(cleaned: DataFrame, by: list[str]) -> DataFrame:
    """Number of corrections of each kind per data set."""
    return cleaned.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.sum(flag).alias(flag.replace("flag_", "n_")) for flag in QUALITY_FLAGS])


# --- time windows -----------------------------------------------------------

def between_dates(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Half-open window [start, end); either end may be open.

    A table partitioned by month is also filtered on its ``mes`` folders.
    """
    monthly = MONTH in df.columns
    if start:
        df = df.where(F.col(DATE) >= F.lit(start).cast("date"))
        df = df.where(F.col(MONTH) >= start[:7]) if monthly else df
    if end:
        df = df.where(F.col(DATE) < F.lit(end).cast("date"))
        df = df.where(F.col(MONTH) <= end[:7]) if monthly else df
    return df


def assign_window(df: DataFrame, windows: dict[str, tuple[str | None, str | None]],
                  column: str = "ventana") -> DataFrame:
    """Label each row with every half-open window it falls in, in one pass."""
    def inside(start, end):
        condition = F.lit(True)
        if start:
            condition = condition & (F.col(DATE) >= F.lit(start).cast("date"))
        if end:
            condition = condition & (F.col(DATE) < F.lit(end).cast("date"))
        return condition

    labels = F.array_compact(F.array(*[F.when(inside(*w), F.lit(name)) for name, w in windows.items()]))
    return df.withColumn(column, F.explode(labels))


def split_guard(train: DataFrame, last_year: int) -> DataFrame:
    """One row with the latest year; fails when training data goes beyond ``last_year``."""
    year = F.max(F.year(DATE))
    message = F.concat(F.lit(f"training data after {last_year}: "), year.cast("string"))
    return train.agg(
        F.when(year > last_year, F.raise_error(message).cast("int")).otherwise(year).alias("ultimo_anio"))
