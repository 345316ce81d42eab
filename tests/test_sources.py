"""Readers and writers."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from tidemark.operators import policy
from tidemark.operators.quality import between_dates
from tidemark.session import shared_folder, spread
from tidemark.sources import sinks
from tidemark.sources.applications import (applications, check_schema, read_applications, read_monthly,
                                           write_applications)


def test_monthly_table_prunes_folders(spark, tmp_path):
    df = applications(spark, SF_DIR)
    path = str(tmp_path / "monthly")
    write_applications(df, path, files_per_month=2)
    window = between_dates(read_monthly(spark, path), "2025-01-01", "2025-02-15")
    assert window.drop("mes").exceptAll(between_dates(df, "2025-01-01", "2025-02-15")).count() == 0
    assert window.count() == between_dates(df, "2025-01-01", "2025-02-15").count()
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(mes" in plan and "PushedFilters: [IsNotNull(fecha_solicitud)" in plan
    assert {r.mes for r in window.select("mes").distinct().collect()} == {"2025-01", "2025-02"}


def test_csv_with_missing_values(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    applications(spark, SF_DIR).withColumn(
        "tasa_interes_anual", F.lit(float("nan"))).write.option("header", True).csv(path)
    back = read_applications(spark, path)
    assert back.where("tasa_interes_anual IS NOT NULL").count() == 0
    assert back.where("ingreso_declarado IS NULL").count() > 0


def test_unlabelled_csv(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    applications(spark, SF_DIR).drop("default_12m").write.option("header", True).csv(path)
    assert "default_12m" not in read_applications(spark, path, labelled=False).columns


def test_schema_check(apps):
    assert check_schema(apps, ["edad", "region"]) is apps
    with pytest.raises(ValueError, match="missing"):
        check_schema(apps, ["sueldo"])
    with pytest.raises(ValueError, match="numeric"):
        check_schema(apps.withColumn("edad", F.lit("x")), ["edad"])


def test_policy_file(spark, apps, tmp_path):
    path = str(tmp_path / "policy")
    sinks.write_policy(policy.decide(policy.add_economics(apps)), path)
    lines = spark.read.option("header", True).csv(path)
    assert lines.columns == ["id_solicitud", "p_default", "p_umbral", "recomendacion_aprobar",
                             "monto_solicitado", "plazo_meses"]
    assert lines.count() == apps.count()


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_applications_are_dealt_by_order_already(spark):
    """Large tables are joined by shuffles: the last of them is by order, so writing by order adds none."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        plan = spread(applications(spark, SF_DIR), "id_solicitud")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "REPARTITION_BY_COL" not in plan and plan.count("Exchange hashpartitioning") == 4
