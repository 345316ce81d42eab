"""Reading loan applications, and deriving them from star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import APPLICATIONS, DATE, ID, MONTH, TARGET

# The last labelled day; later applications have no outcome yet.
LABELLED_UNTIL = "2025-02-15"


def nan_to_null(df: DataFrame) -> DataFrame:
    """One missing value: Spark orders NaN above every number, so
    ``NaN > limit`` would be true."""
    return df.select(*[
        F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def read_applications(spark: SparkSession, path: str, fmt: str = "csv",
                      labelled: bool = True) -> DataFrame:
    """Applications from CSV or a columnar format, with the declared schema."""
    schema = APPLICATIONS if labelled else T.StructType(
        [f for f in APPLICATIONS.fields if f.name != TARGET])
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "FAILFAST")
    return nan_to_null(reader.format(fmt).load(path))


def write_applications(df: DataFrame, path: str, files_per_month: int = 64) -> None:
    """Columnar copy partitioned by month, so time windows prune whole folders.
    A month is spread over several tasks: one of them may hold a third of all rows."""
    salt = F.pmod(F.xxhash64(ID), F.lit(files_per_month))
    (df.withColumn(MONTH, F.date_format(DATE, "yyyy-MM")).repartition(MONTH, salt)
       .sortWithinPartitions(MONTH, DATE).write.partitionBy(MONTH).parquet(path))


def read_monthly(spark: SparkSession, path: str) -> DataFrame:
    """A table written by :func:`write_applications`, with its ``mes`` column."""
    schema = T.StructType([*APPLICATIONS.fields, T.StructField(MONTH, T.StringType())])
    return nan_to_null(spark.read.schema(schema).parquet(path))


def check_schema(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail before scoring when an expected column is missing or mistyped."""
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in columns if c not in have]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    declared = {f.name: f.dataType for f in APPLICATIONS.fields}
    wrong = [c for c in columns if isinstance(declared.get(c), T.NumericType)
             and not isinstance(have[c], T.NumericType)]
    if wrong:
        raise ValueError(f"columns that are not numeric: {wrong}")
    return df


# Declared columns of the star-schema tables: reading with a schema spares a
# job per table that would only open files to infer one.
TABLES = {
    "lineitem": "l_orderkey long, l_extendedprice double, l_discount double, "
                "l_returnflag string, l_linestatus string",
    "orders": "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string",
    "customer": "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications derived from orders, their lines and their customers.

    Prices and discounts are summed as whole hundredths: exact in any order, and
    cheaper per row than decimals. Orders meet their customers first, while they are narrow, and their lines,
    summed per order, last: the result is then dealt by order, which no customer can swell, and
    writing it by order needs no further shuffle. Nations and regions are fixed lists of 25
    and 5 rows and are joined to the customers, not to the orders.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.expr("CAST(COUNT(*) AS INT)").alias("n_items"),
        F.expr("CAST(COUNT_IF(l_returnflag = 'R') AS INT)").alias("n_r"),
        F.expr("CAST(COUNT_IF(l_returnflag = 'A') AS INT)").alias("n_a"),
        F.expr("CAST(COUNT_IF(l_linestatus = 'O') AS INT)").alias("n_o"),
        F.expr("CAST(SUM(FLOOR(l_discount * 100 + 0.5D)) AS INT)").alias("disc_pts"),
        F.expr("CAST(SUM(FLOOR(l_extendedprice * 100 + 0.5D)) AS DOUBLE) / 100").alias("ext"))
    nations = F.broadcast(table(spark, sf_dir, "nation"))
    regions = F.broadcast(table(spark, sf_dir, "region"))
    customers = (table(spark, sf_dir, "customer")
                 .join(nations, F.expr("c_nationkey = n_nationkey"))
                 .join(regions, F.expr("n_regionkey = r_regionkey")))
    base = (table(spark, sf_dir, "orders")
            .join(customers, F.expr("o_custkey = c_custkey"))
            .join(lines, F.expr("o_orderkey = l_orderkey"))
            .withColumn("dflt", F.expr("CAST(n_r >= 2 AND 2 * n_r > n_items AS INT)")))
    return base.selectExpr(
        "o_orderkey AS id_solicitud",
        "DATE_ADD(DATE'2024-01-01', CAST(o_orderkey % 530 AS INT)) AS fecha_solicitud",
        "CAST(15 + (o_custkey * 37) % 92 AS INT) AS edad",
        """CASE c_mktsegment WHEN 'BUILDING' THEN 'independiente' WHEN 'FURNITURE' THEN 'informal'
           WHEN 'HOUSEHOLD' THEN 'jubilado' ELSE 'dependiente' END AS tipo_empleo""",
        "CASE WHEN c_acctbal >= 0 THEN ROUND(c_acctbal * 1000) END AS ingreso_declarado",
        """CASE WHEN c_mktsegment NOT IN ('FURNITURE', 'HOUSEHOLD')
           THEN CAST(o_custkey % 240 AS DOUBLE) END AS antiguedad_laboral_meses""",
        "r_name AS region",
        """CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'digital'
           WHEN o_orderpriority = '5-LOW' THEN 'partner' ELSE 'sucursal' END AS canal""",
        "CAST((o_custkey * 13) % 120 AS INT) AS antiguedad_cliente_meses",
        "CAST(GREATEST(300, 850 - 60 * n_r - o_orderkey % 197) AS INT) AS score_buro",
        "ext AS deuda_sistema",
        "n_items AS num_creditos_vigentes",
        "CAST((30 * n_o) % 120 AS INT) AS peor_morosidad_12m",
        "CAST(dflt * 5 + o_orderkey % 3 AS INT) AS num_contactos_ult_trimestre",
        "n_a AS num_consultas_buro_3m",
        "CAST(disc_pts * 10 AS DOUBLE) / n_items AS uso_linea_credito_pct",
        "CAST(FLOOR(o_totalprice * 20 + 0.5D) AS DOUBLE) AS monto_solicitado",
        "ELEMENT_AT(ARRAY(6, 12, 18, 24, 36, 48), CAST(o_orderkey % 6 AS INT) + 1) AS plazo_meses",
        "CAST(1800 + (o_orderkey * 31) % 2500 AS DOUBLE) / 100 AS tasa_interes_anual",
        """ELEMENT_AT(ARRAY('lunes', 'martes', 'miercoles', 'jueves', 'viernes', 'sabado', 'domingo'),
           CAST(o_custkey % 7 AS INT) + 1) AS dia_semana_solicitud""",
        "dflt AS default_12m")


def p_proxy() -> Column:
    """A fixed score with many ties, for checks that need no fitted model."""
    return F.expr("CAST(LEAST(900, GREATEST(5, 850 - score_buro)) AS DOUBLE) / 1000")
