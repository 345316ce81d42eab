"""Column names, types and roles of a loan application."""

from __future__ import annotations

from pyspark.sql import types as T

ID = "id_solicitud"
DATE = "fecha_solicitud"
TARGET = "default_12m"
SCORE = "p_default"
MONTH = "mes"          # partition folder of a stored table, as yyyy-MM

APPLICATIONS = T.StructType([
    T.StructField("id_solicitud", T.LongType()),
    T.StructField("fecha_solicitud", T.DateType()),
    T.StructField("edad", T.IntegerType()),
    T.StructField("tipo_empleo", T.StringType()),
    T.StructField("ingreso_declarado", T.DoubleType()),
    T.StructField("antiguedad_laboral_meses", T.DoubleType()),
    T.StructField("region", T.StringType()),
    T.StructField("canal", T.StringType()),
    T.StructField("antiguedad_cliente_meses", T.IntegerType()),
    T.StructField("score_buro", T.IntegerType()),
    T.StructField("deuda_sistema", T.DoubleType()),
    T.StructField("num_creditos_vigentes", T.IntegerType()),
    T.StructField("peor_morosidad_12m", T.IntegerType()),
    T.StructField("num_contactos_ult_trimestre", T.IntegerType()),
    T.StructField("num_consultas_buro_3m", T.IntegerType()),
    T.StructField("uso_linea_credito_pct", T.DoubleType()),
    T.StructField("monto_solicitado", T.DoubleType()),
    T.StructField("plazo_meses", T.IntegerType()),
    T.StructField("tasa_interes_anual", T.DoubleType()),
    T.StructField("dia_semana_solicitud", T.StringType()),
    T.StructField("default_12m", T.IntegerType()),
])

# Column roles (fixed values: the feature list a scoring model expects, in order).
CATEGORICAL = ["tipo_empleo", "region", "canal"]
LOGGED = ["deuda_sistema", "monto_solicitado"]
PLAIN = [
    "edad", "antiguedad_cliente_meses", "score_buro", "num_creditos_vigentes",
    "peor_morosidad_12m", "num_consultas_buro_3m", "uso_linea_credito_pct",
    "plazo_meses", "tasa_interes_anual",
]
QUALITY_FLAGS = ["flag_edad_inconsistente", "flag_ingreso_inconsistente", "flag_tasa_corregida"]
IMPUTED = ["ingreso_declarado", "antiguedad_laboral_meses"]

# A collections trace recorded after the outcome, and a weekday that does not
# match the date: neither may reach a model.
LEAK = "num_contactos_ult_trimestre"
UNRELIABLE = "dia_semana_solicitud"


def feature_columns(plain=PLAIN, categorical=CATEGORICAL) -> list[str]:
    """Ordered raw feature list; a column named twice keeps its first place."""
    wanted = ["ingreso_declarado", "tipo_empleo", "antiguedad_laboral_meses",
              *LOGGED, *plain, *categorical]
    return list(dict.fromkeys(wanted))
