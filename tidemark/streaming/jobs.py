"""Scoring arriving applications, and monitoring default rates over time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import policy
from tidemark.schema import APPLICATIONS, DATE, ID, SCORE, TARGET
from tidemark.sources.applications import nan_to_null

WINDOW_DAYS = 30
WINDOW = f"{WINDOW_DAYS} days"


def stream_applications(spark: SparkSession, path: str, fmt: str = "parquet",
                        schema: T.StructType = APPLICATIONS, **options) -> DataFrame:
    """Applications read from files as they arrive."""
    reader = spark.readStream.schema(schema).options(**options)
    if fmt == "csv":
        reader = reader.option("header", True)
    return nan_to_null(reader.format(fmt).load(path))


def stream_score(source: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score and decide each application. Nothing is kept between batches; the
    rate calendar and fitted medians are static sides of broadcast joins."""
    return policy.policy_output(policy.decide(policy.add_economics(score(source))))


def stream_default_rate(source: DataFrame, delay: str | None = None, score: str = SCORE) -> DataFrame:
    """Observed and predicted default rate and approval share per window.

    An application reported twice counts once. Without ``delay`` no row is ever
    late: the answer doesn't depend on how arrivals are cut into batches, every
    window is reported from its first row on (write it with ``complete``), and
    the ids seen are kept in the state store. With ``delay`` ids and windows are
    forgotten once the watermark has passed them (write it with ``append``);
    rows that come later than that are counted by Spark as dropped, see
    `late_rows`, and the source should deliver files in order of date.
    """
    timed = source.withColumn("momento", F.col(DATE).cast("timestamp"))
    if delay is None:
        once = timed.dropDuplicates([ID])
    else:
        once = timed.withWatermark("momento", delay).dropDuplicatesWithinWatermark([ID])
    decided = policy.decide(policy.add_economics(once), score)
    rates = decided.groupBy(F.window("momento", WINDOW).alias("ventana")).agg(
        F.count("*").alias("n"),
        F.avg(F.col(TARGET).cast("double")).alias("tasa_observada"),
        F.avg(score).alias("tasa_predicha"),
        F.avg(F.col("aprobar").cast("double")).alias("pct_aprob"))
    return rates.select(
        F.to_date("ventana.start").alias("desde"), F.to_date("ventana.end").alias("hasta"),
        "n", "tasa_observada", "tasa_predicha", "pct_aprob")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query with a watermark has dropped so far."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def start(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append to files, taking what has arrived and then stopping."""
    return (stream.writeStream.format(fmt).outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def start_complete(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Replace the table at ``path`` by the whole current result after each batch.

    A batch that is run again writes the same table again.
    """
    def replace(batch: DataFrame, _: int) -> None:
        batch.write.format(fmt).mode("overwrite").save(path)
    return (stream.writeStream.outputMode("complete").foreachBatch(replace)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def window_start(day: str = DATE) -> Column:
    """First day of the 30-day window of a date, counted from 1970."""
    return F.date_add(F.lit("1970-01-01").cast("date"), (F.floor(F.unix_date(day) / WINDOW_DAYS) * WINDOW_DAYS).cast("int"))


def start_monitor(stream: DataFrame, folder: str, checkpoint: str, delay: int, score: str = SCORE) -> StreamingQuery:
    """Default rates by window, each reported once, when the latest date seen is ``delay`` days past its end.

    Rows of a window that has been reported are late: they change nothing and go to a table of their own, with their
    window. Tables of ``folder``, partitioned by batch (``lote``):

    * ``cerrada``: desde, hasta, n, tasa_observada, tasa_predicha of the windows that the batch closed
    * ``tarde``: id, date, desde, hasta of its late rows
    * ``sumas`` and ``ids``: sums and applications of the windows still open, all that later batches need. They shrink
      as windows close; an application reported twice while its window is open counts once.
    * ``limite``: the day up to which windows are closed

    A batch reads only the tables of the batch before and replaces its own partitions, so one that is run again after
    a failure writes the same.
    """
    spark = stream.sparkSession
    at = lambda table, lote: f"{folder}/{table}/lote={lote}"
    sums = ("n", "suma_observada", "n_observada", "suma_predicha")

    def take(batch: DataFrame, lote: int) -> None:
        put = lambda rows, table: rows.write.mode("overwrite").parquet(at(table, lote))
        rows = (batch.select(ID, DATE, TARGET, F.col(score).alias("p"), window_start().alias("desde"))
                .withColumn("hasta", F.date_add("desde", WINDOW_DAYS)).persist())
        before = spark.read.parquet(at("limite", lote - 1)).first().limite if lote else None
        latest = rows.agg(F.max(DATE)).first()[0]
        days = [d for d in (before, latest - dt.timedelta(delay) if latest else None) if d]
        limit = F.lit(max(days) if days else None).cast("date")
        late = F.coalesce(F.col("hasta") <= F.lit(before).cast("date"), F.lit(False))
        put(rows.where(late).select(ID, DATE, "desde", "hasta"), "tarde")
        new = rows.where(~late).dropDuplicates([ID])
        if lote:
            new = new.join(spark.read.parquet(at("ids", lote - 1)), ID, "left_anti")
        total = new.groupBy("desde", "hasta").agg(
            F.count("*").alias("n"), F.sum(F.col(TARGET).cast("double")).alias("suma_observada"),
            F.count(TARGET).alias("n_observada"), F.sum("p").alias("suma_predicha"))
        known = new.select(ID, "hasta")
        if lote:
            total = (total.unionByName(spark.read.parquet(at("sumas", lote - 1)))
                     .groupBy("desde", "hasta").agg(*(F.sum(c).alias(c) for c in sums)))
            known = known.unionByName(spark.read.parquet(at("ids", lote - 1)))
        closed = F.coalesce(F.col("hasta") <= limit, F.lit(False))
        total = total.persist()
        put(total.where(closed).select(
            "desde", "hasta", "n", F.try_divide("suma_observada", F.col("n_observada")).alias("tasa_observada"),
            F.try_divide("suma_predicha", F.col("n")).alias("tasa_predicha")), "cerrada")
        put(total.where(~closed), "sumas")
        put(known.where(~closed), "ids")
        put(spark.range(1).select(limit.alias("limite")), "limite")
        total.unpersist()
        rows.unpersist()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
