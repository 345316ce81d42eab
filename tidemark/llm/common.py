"""Helpers shared by the operators: staged tables, distributed prefix sums, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import write_stage

#: Multipliers of the 64-bit finaliser behind every hash in numpy here.
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit hash of 64-bit integers."""
    x = x + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def fold(remainder_of: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids give null."""
    return F.crc32(F.col(remainder_of).cast("string")) % modulus


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Numbers rows by place in the scan, so that equal rows stay apart.

    ``df`` must give the same partitions each time it is read, as a table does.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def prefix_sum(df: DataFrame, order: list[Column], value: str, out: str, name: str) -> DataFrame:
    """Adds ``out``: the sum of long ``value`` over all rows before this one in ``order``.

    The rows are range-partitioned and summed within partitions; what goes to
    the driver is one number per partition. ``order`` should be a unique key, so
    that no range is larger than the others. The result is a staged table.
    """
    fields = df.schema.fieldNames()
    at = fields.index(value)
    schema = df.withColumn("_part", F.lit(0)).withColumn("_within", F.lit(0).cast("long")).schema

    def sums(batches):
        from pyspark import TaskContext
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            v = np.asarray(batch.column(at).to_numpy(zero_copy_only=False), dtype=np.int64)
            ends = total + np.cumsum(v)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(v), part, np.int32)), pa.array(ends - v)],
                names=[*batch.schema.names, "_part", "_within"])
            total = int(ends[-1]) if len(ends) else total

    staged = write_stage(df.repartitionByRange(*order).sortWithinPartitions(*order)
                         .mapInArrow(sums, schema), name)
    totals = sorted((r._part, r.total) for r in staged.groupBy("_part").agg(F.sum(value).alias("total")).collect())
    starts, before = [], 0
    for part, total in totals:
        starts.append((part, before))
        before += total
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    return (staged.join(F.broadcast(offsets), "_part")      # one row per partition
            .withColumn(out, F.col("_start") + F.col("_within")).drop("_part", "_start", "_within"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges`` (a, b long): rows (node, root), root the least node.

    Alternates the large-star and small-star steps, each a grouping by node, and
    stages every round, so that lineage stays short. A node with a third of all
    edges only contributes partial minima.
    """
    now = write_stage(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), name)
    state = None
    while True:
        both = now.select("a", "b").union(now.selectExpr("b AS a", "a AS b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").selectExpr("b AS a", "m AS b")
        down = large.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (down.join(low, "a").selectExpr("CASE WHEN b = m THEN a ELSE b END AS a", "m AS b")
                 .where("a <> b").distinct())
        now = write_stage(small, name)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if seen == state:
            break
        state = seen
    nodes = now.selectExpr("a AS node", "b AS root")
    return nodes.union(now.selectExpr("b AS node", "b AS root").distinct())


#: Bytes of text that a task turns into Python objects at a time.
SLICE_BYTES = 1 << 20


def byte_slices(texts: pa.Array, most: int = SLICE_BYTES):
    """(start, stop) of runs of rows with ``most`` bytes of text at most, or of a single longer row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, stop
        at = stop


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def string_batches(batches, column: int):
    """(batch, list of texts) with null as the empty text."""
    for batch in batches:
        yield batch, [t or "" for t in batch.column(column).to_pylist()]
