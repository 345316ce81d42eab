"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a row group of a staged table: a writing task holds one, whole texts included.
ROW_GROUP = 16 << 20
#: Paths of the tables that go when the innermost `passing` of this thread ends.
PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def build_session(app_name: str = "tidemark", master: str | None = None,
                  **settings: str) -> SparkSession:
    """Session with the settings the library is tuned for.

    ``master`` is left to spark-submit on a cluster. Shuffle partitions start
    high and AQE coalesces them, so one setting serves small and large inputs.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # streaming state may outgrow memory: one entry per application id
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        # no Python stack capture for each column expression
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **{key.replace("__", "."): value for key, value in settings.items()},
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder: executors on
    other machines could not read one.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def _stages(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tidemark/{spark.sparkContext.applicationId}"


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, among those of this application."""
    return f"{_stages(spark)}/{name}-{uuid.uuid4().hex}"


def drop_stages(spark: SparkSession) -> None:
    """Delete all that this application has staged; results not yet read are lost with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_stages(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _file(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, path: str) -> bool:
    files, path = _file(spark, path)
    return files.exists(path)


def mark(spark: SparkSession, path: str) -> None:
    """An empty file."""
    files, path = _file(spark, path)
    files.create(path, True).close()


def ledger(spark: SparkSession) -> str:
    """Folder of fits that outlive this application."""
    return f"{shared_folder(spark)}/tidemark-fits"


def drop_ledger(spark: SparkSession) -> None:
    files, path = _file(spark, ledger(spark))
    files.delete(path, True)


def table_state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Bytes, files and time of change of a table, to tell whether it is still the same."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    summary = files.getContentSummary(path)
    return summary.getLength(), summary.getFileCount(), files.getFileStatus(path).getModificationTime()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Even out a frame that is about to be written once and read many times.

    A unique key breaks up whatever clustering the last join left, such as one
    customer with a third of the rows. The number of partitions is left to AQE.
    """
    return df.repartition(key)


@contextmanager
def passing(spark: SparkSession):
    """Deletes the tables that this thread stages inside, other than those to keep, at the end.

    Whatever reads them must have been written by then.
    """
    paths: list[str] = []
    token = PASSING.set(paths)
    try:
        yield
    finally:
        PASSING.reset(token)
        for path in paths:
            files, at = _file(spark, path)
            files.delete(at, True)


def write_stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Several passes over the result then cost a columnar scan each, and a lost
    executor costs a re-read instead of a recomputation. ``keep``: the table outlives a `passing` around it.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    if not keep and PASSING.get() is not None:
        PASSING.get().append(path)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
