"""Month labels and the dated reference series (rate caps, inflation unit)."""

from __future__ import annotations

import datetime as dt
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month labels.
MONTH_LABELS = [
    "01-enero", "02-febrero", "03-marzo", "04-abril", "05-mayo", "06-junio",
    "07-julio", "08-agosto", "09-septiembre", "10-octubre", "11-noviembre", "12-diciembre",
]

# Legal maximum yearly rate (%) by certificate date, for amounts
# up to 50 UF, up to 200 UF, and above.
RATE_CAPS = [
    ("2023-12-15", 41.68, 34.68, 31.02),
    ("2024-01-15", 41.88, 34.88, 31.32),
    ("2024-02-15", 41.06, 34.06, 30.09),
    ("2024-04-15", 39.40, 32.40, 27.60),
    ("2024-06-15", 39.08, 32.08, 27.12),
    ("2024-07-15", 38.58, 31.58, 26.37),
    ("2024-08-14", 38.58, 31.58, 26.37),
    ("2024-09-15", 38.16, 31.16, 25.74),
    ("2024-10-15", 38.10, 31.10, 25.65),
    ("2024-11-15", 38.20, 31.20, 25.80),
    ("2024-12-14", 38.56, 31.56, 26.34),
    ("2025-01-15", 39.08, 32.08, 27.12),
]

# Inflation unit (UF) in pesos by date.
UF_VALUES = [
    ("2024-01-01", 36797.64), ("2024-01-15", 36828.19),
    ("2024-02-01", 36727.10), ("2024-02-15", 36732.60),
    ("2024-03-01", 36865.37), ("2024-03-15", 36979.17),
    ("2024-04-01", 37100.68), ("2024-04-15", 37187.68),
    ("2024-05-01", 37266.94), ("2024-05-15", 37342.66),
    ("2024-06-01", 37444.94), ("2024-06-15", 37515.63),
    ("2024-07-01", 37575.61), ("2024-07-15", 37598.36),
    ("2024-08-01", 37577.74), ("2024-08-15", 37618.79),
    ("2024-09-01", 37762.97), ("2024-09-15", 37853.68),
    ("2024-10-01", 37914.20), ("2024-10-15", 37951.84),
    ("2024-11-01", 37972.65), ("2024-11-15", 38058.10),
    ("2024-12-01", 38260.61), ("2024-12-15", 38377.10),
    ("2025-01-01", 38419.17), ("2025-01-15", 38424.09),
    ("2025-02-01", 38381.93), ("2025-02-15", 38452.14),
]

SMALL_AMOUNT_UF = 50
MEDIUM_AMOUNT_UF = 200


def month_label(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_LABELS]), F.month(day))


def _days(rows) -> np.ndarray:
    return np.array([dt.date.fromisoformat(row[0]).toordinal() for row in rows])


@cache
def _calendar() -> pa.Table:
    """One row per day between the first and the last knot of either series.

    Values are interpolated between knots and held flat outside; the
    ``_vigente`` caps are those of the last certificate on or before the day.
    """
    cap_days, uf_days = _days(RATE_CAPS), _days(UF_VALUES)
    days = np.arange(min(cap_days[0], uf_days[0]), max(cap_days[-1], uf_days[-1]) + 1)
    columns = {"dia": pa.array([dt.date.fromordinal(int(day)) for day in days], pa.date32()),
               "uf": np.interp(days, uf_days, [row[1] for row in UF_VALUES])}
    in_force = np.clip(np.searchsorted(cap_days, days, side="right") - 1, 0, None)
    for position, band in enumerate(("tope_50", "tope_200", "tope_5000"), 1):
        knots = np.array([row[position] for row in RATE_CAPS])
        columns[band] = np.interp(days, cap_days, knots)
        columns[f"{band}_vigente"] = knots[in_force]
    return pa.table(columns)


def rate_calendar(spark: SparkSession) -> DataFrame:
    """The reference series by day. Its length is fixed by the knots above
    (under 500 rows), which is what makes broadcasting it safe."""
    return spark.createDataFrame(_calendar())


def calendar_bounds() -> tuple[dt.date, dt.date]:
    days = _calendar()["dia"]
    return days[0].as_py(), days[-1].as_py()


def with_rate_cap(df: DataFrame, day: str = "fecha_solicitud",
                  amount: str = "monto_solicitado", step: bool = False) -> DataFrame:
    """Add ``uf`` and ``tope_tasa``: the cap for the row's day and amount band.

    Days outside the series are clamped to its ends, so the lookup is an
    equality join on the day. A missing amount falls in the top band.
    """
    first, last = calendar_bounds()
    suffix = "_vigente" if step else ""
    series = rate_calendar(df.sparkSession).select(
        F.col("dia"), F.col("uf"),
        *[F.col(f"tope_{band}{suffix}").alias(f"__tope_{band}") for band in (50, 200, 5000)])
    clamped = F.least(F.greatest(F.col(day), F.lit(first)), F.lit(last))
    in_uf = F.col(amount) / F.col("uf")
    cap = (F.when(in_uf <= SMALL_AMOUNT_UF, F.col("__tope_50"))
            .when(in_uf <= MEDIUM_AMOUNT_UF, F.col("__tope_200"))
            .otherwise(F.col("__tope_5000")))
    return (
        df.withColumn("dia", clamped)
        .join(F.broadcast(series), "dia", "left")
        .withColumn("tope_tasa", cap)
        .drop("dia", "__tope_50", "__tope_200", "__tope_5000")
    )
