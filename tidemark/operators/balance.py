"""Class weights and synthetic minority rows."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.encode import FEATURES
from tidemark.operators.knn import nearest
from tidemark.schema import ID, TARGET
from tidemark.session import write_stage

INDEX_BUCKETS = 65_536


def class_weights(df: DataFrame, target: str = TARGET) -> DataFrame:
    """One row: class sizes, balanced weight of each class, boosting weight of
    the positive class."""
    n, pos = F.count("*"), F.count_if(F.col(target) == 1)
    return df.agg(n.alias("n"), pos.alias("n_pos"), (n - pos).alias("n_neg")).select(
        "n", "n_pos", "n_neg",
        F.try_divide(F.col("n").cast("double"), 2.0 * F.col("n_pos")).alias("peso_pos"),
        F.try_divide(F.col("n").cast("double"), 2.0 * F.col("n_neg")).alias("peso_neg"),
        F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos").cast("double")).alias("scale_pos_weight"))


def with_weight(df: DataFrame, positive: float, negative: float, target: str = TARGET) -> DataFrame:
    return df.withColumn("peso", F.when(F.col(target) == 1, F.lit(float(positive)))
                         .otherwise(F.lit(float(negative))))


def _dense_index(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Number the rows 0..n-1 in a seeded order that does not depend on partitions."""
    hashed = df.withColumn("h", F.xxhash64(key, F.lit(seed)))
    bucketed = hashed.withColumn("bucket", F.pmod("h", F.lit(INDEX_BUCKETS)))
    sizes = bucketed.groupBy("bucket").agg(F.count("*").alias("size"))      # INDEX_BUCKETS rows
    before = sizes.select("bucket", (
        F.sum("size").over(Window.orderBy("bucket")) - F.col("size")).alias("before"))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("h", key))
    return (bucketed.withColumn("within", within).join(F.broadcast(before), "bucket")
            .withColumn("pos", F.col("before") + F.col("within") - 1)
            .drop("h", "bucket", "within", "before"))


def _draw(seed: int, stream: int, modulus: int) -> Column:
    return F.pmod(F.xxhash64("i", F.lit(seed), F.lit(stream)), F.lit(modulus))


def minority_neighbours(minority: DataFrame, k: int, key: str = ID) -> DataFrame:
    """``key`` and ``found``: the k nearest other minority rows, nearest first,
    as (d, value, n) where ``value`` is the smallest id of n equal rows."""
    rows = minority.select(F.col(key).alias("qid"), F.lit(0).alias("cls"), "vec")
    distinct = minority.groupBy(F.lit(0).alias("cls"), "vec").agg(
        F.min(key).alias("value"), F.count("*").alias("n"))
    found = nearest(rows, distinct, k + 1, {0: 1.0}, "long")
    # the row itself is one of the rows at distance zero
    others = F.filter(F.transform("found", lambda c: F.struct(
        c.d.alias("d"), c.value.alias("value"),
        F.when(c.d == 0, c.n - 1).otherwise(c.n).alias("n"))), lambda c: c.n > 0)
    return found.select(F.col("qid").alias(key), others.alias("found"))


def _pick(found: Column, j: Column) -> Column:
    """Value of the j-th neighbour (0-based), equal rows counting separately."""
    start = F.struct(j.cast("long").alias("left"), F.lit(None).cast("long").alias("value"))
    return F.aggregate(found, start, lambda acc, c: F.struct(
        (acc.left - c.n).alias("left"),
        F.when(acc.left >= 0, c.value).otherwise(acc.value).alias("value")))["value"]


class MinoritySpace:
    """Numbered minority rows and their neighbours, shared by several ratios."""

    def __init__(self, df: DataFrame, k: int = 5, seed: int = 42, features: str = FEATURES,
                 target: str = TARGET, key: str = ID):
        self.k, self.seed, self.key, self.target, self.features = k, seed, key, target, features
        self.kept = df.select(key, target, features)
        sizes = dict(self.kept.groupBy(target).count().collect())
        self.n_min, self.n_maj = sizes.get(1, 0), sizes.get(0, 0)
        if self.n_min <= k:
            raise ValueError(f"{k} neighbours need more than {k} minority rows")
        self.rows = write_stage(
            _dense_index(self.kept.where(F.col(target) == 1), key, seed)
            .withColumn("vec", vector_to_array(features)).select(key, "pos", "vec"), "minority")
        self.found = write_stage(minority_neighbours(self.rows, k, key), "minority-neighbours")

    def synthetic(self, ratio: float) -> DataFrame:
        n_new = math.floor(ratio * self.n_maj - self.n_min)
        if n_new < 0:
            raise ValueError(f"the minority already exceeds {ratio} of the majority")
        # bases are drawn evenly, so the join on their number has no hot key
        draws = self.kept.sparkSession.range(n_new).withColumnRenamed("id", "i").select(
            "i", _draw(self.seed, 1, self.n_min).alias("pos"), _draw(self.seed, 2, self.k).alias("j"),
            (_draw(self.seed, 3, 1 << 53) / F.lit(float(1 << 53))).alias("u"))
        bases = draws.join(self.rows, "pos").join(self.found, self.key).select(
            "i", "u", F.col("vec").alias("base"), _pick(F.col("found"), F.col("j")).alias("other"))
        others = self.rows.select(F.col(self.key).alias("other"), F.col("vec").alias("end"))
        label = F.lit(1).cast(self.kept.schema[self.target].dataType)
        between = F.zip_with("base", "end", lambda a, b: a + F.col("u") * (b - a))
        return bases.join(others, "other").select(
            (-F.col("i") - 1).alias(self.key), label.alias(self.target),
            array_to_vector(between).alias(self.features))


def smote(df: DataFrame, ratio: float | None, space: MinoritySpace | None = None,
          features: str = FEATURES, target: str = TARGET, key: str = ID) -> DataFrame:
    """Add synthetic minority rows until minority / majority reaches ``ratio``.

    Each new row lies between a minority row and one of its k nearest minority
    rows. Every draw is a hash of the row's number, so the result does not
    depend on partitioning. New rows get negative ids; the rest is untouched.
    """
    if ratio is None:
        return df.select(key, target, features)
    space = space or MinoritySpace(df, features=features, target=target, key=key)
    return space.kept.unionByName(space.synthetic(ratio))
