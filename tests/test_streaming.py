"""Streams agree with the batch result and count an application once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import policy
from tidemark.sources.applications import p_proxy
from tidemark.streaming import jobs


def run(stream, tmp_path, name):
    out = str(tmp_path / name)
    jobs.start(stream, out, str(tmp_path / f"{name}-state")).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def test_scores_equal_batch(spark, apps, tmp_path):
    source = str(tmp_path / "in")
    apps.drop("p_default").repartition(4).write.parquet(source)
    stream = jobs.stream_applications(spark, source, maxFilesPerTrigger=1)
    got = run(jobs.stream_score(stream, lambda d: d.withColumn("p_default", p_proxy())), tmp_path, "out")
    want = policy.policy_output(policy.decide(policy.add_economics(apps)))
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


@pytest.mark.parametrize("files", [1, 4, 16])
def test_rates_do_not_depend_on_batches(spark, apps, tmp_path, files):
    """Shuffled arrivals, each file a batch, every application reported twice."""
    rows = apps.drop("p_default")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.unionByName(rows).repartition(files, F.xxhash64("id_solicitud", F.rand(3))).write.parquet(source)
    stream = jobs.stream_applications(spark, source, maxFilesPerTrigger=1).withColumn("p_default", p_proxy())
    jobs.start_complete(jobs.stream_default_rate(stream), out, str(tmp_path / "state")).awaitTermination()
    got = {r.desde: (r.n, round(r.tasa_observada, 9)) for r in spark.read.parquet(out).collect()}
    start = F.window(F.col("fecha_solicitud").cast("timestamp"), "30 days").start
    want = {r[0]: (r[1], round(r[2], 9)) for r in
            rows.groupBy(F.to_date(start)).agg(F.count("*"), F.avg("default_12m")).collect()}
    assert got == want


def test_watermark_counts_what_comes_late(spark, apps, tmp_path):
    rows, source = apps.drop("p_default"), str(tmp_path / "in")
    last = rows.agg(F.max("fecha_solicitud")).first()[0]
    rows.where(F.col("fecha_solicitud") > F.lit(last) - F.expr("INTERVAL 5 DAYS")).coalesce(1).write.parquet(source)
    old = rows.where(F.col("fecha_solicitud") < "2024-03-01")

    def run_once():
        stream = jobs.stream_applications(spark, source).withColumn("p_default", p_proxy())
        query = jobs.start(jobs.stream_default_rate(stream, "60 days"), str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination()
        return query
    assert jobs.late_rows(run_once()) == 0
    old.coalesce(1).write.mode("append").parquet(source)
    assert jobs.late_rows(run_once()) >= old.count()


def test_monitor_keeps_only_open_windows(spark, tmp_path):
    """Batches out of order, an application reported twice, a late row, and a batch that is run again."""
    day = lambda n: dt.date(1970, 1, 1) + dt.timedelta(600 * 30 + n)        # day 0 starts a window
    schema = "id_solicitud long, fecha_solicitud date, default_12m int, p_default double"
    batches = [[(1, day(3), 1, .5), (2, day(20), 0, .1), (3, day(31), 1, .3)],
               [(2, day(20), 0, .1), (4, day(29), 1, .6), (5, day(75), 0, .2), (5, day(75), 0, .2)],
               [(6, day(10), 1, .9), (7, day(100), None, .4), (8, day(64), 0, .8)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.start_monitor(stream, str(tmp_path / "out"), str(tmp_path / "state"), 10).awaitTermination()
    read = lambda table: spark.read.parquet(str(tmp_path / "out" / table))
    closed = {(r.lote, r.desde): (r.n, r.tasa_observada, round(r.tasa_predicha, 9)) for r in read("cerrada").collect()}
    assert closed == {(1, day(0)): (3, 2 / 3, .4), (1, day(30)): (1, 1.0, .3), (2, day(60)): (2, 0.0, .5)}
    assert [(r.lote, r.id_solicitud, r.desde) for r in read("tarde").collect()] == [(2, 6, day(0))]
    assert {r.lote: r["count"] for r in read("ids").groupBy("lote").count().collect()} == {0: 3, 1: 1, 2: 1}
    assert [r.n for r in read("sumas").where("lote = 2").collect()] == [1]


def test_monitor_batch_run_again_writes_the_same(spark, tmp_path):
    schema = "id_solicitud long, fecha_solicitud date, default_12m int, p_default double"
    for i in range(2):
        spark.createDataFrame([(9 * i + k, dt.date(2024, 1 + 3 * i, 1 + k), k % 2, .25) for k in range(9)], schema) \
            .coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.start_monitor(stream, str(tmp_path / "out"), str(tmp_path / "state"), 10).awaitTermination()
    tables = ("cerrada", "tarde", "sumas", "ids", "limite")
    read = lambda: {t: sorted(map(repr, spark.read.parquet(str(tmp_path / "out" / t)).collect())) for t in tables}
    first = read()
    (tmp_path / "state" / "commits" / "1").unlink()          # as if the driver was lost before the commit
    (tmp_path / "state" / "commits" / ".1.crc").unlink(missing_ok=True)
    jobs.start_monitor(stream, str(tmp_path / "out"), str(tmp_path / "state"), 10).awaitTermination()
    assert read() == first and len(first["cerrada"]) == 1


def test_arrivals_of_a_batch_are_many_files(spark, monkeypatch):
    """Each quarter is one batch, though several tasks wrote it."""
    import glob
    from conftest import SF_DIR
    from tidemark.catalog import queries
    places, path, stage = {}, queries.stage_path, queries.write_stage
    monkeypatch.setattr(queries, "stage_path", lambda s, name: places.setdefault(name, path(s, name)))
    monkeypatch.setattr(queries, "write_stage", lambda df, name: stage(df.repartition(6), name))
    lotes = {r.lote for r in queries.QUERIES["stream_late_rows"](spark, SF_DIR).select("lote").collect()}
    files = glob.glob(places["arrivals"].removeprefix("file:") + "/*.parquet")
    batches = glob.glob(places["monitor"].removeprefix("file:") + "/limite/lote=*")
    assert len(files) > 3 * len(batches) and lotes <= set(range(len(batches))) and 6 <= len(batches) <= 9
