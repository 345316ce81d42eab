"""As-of and interval joins against all pairs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import temporal


def frames(spark, seed, hot):
    draw = random.Random(seed)
    key = lambda: None if draw.random() < .05 else "hot" if draw.random() < hot else draw.choice("abc")
    time = lambda: None if draw.random() < .05 else draw.randrange(60)
    left = [(i, key(), time()) for i in range(300)]
    left += left[:5]
    right = [(key(), time(), draw.randrange(4), draw.choice(["x", None])) for _ in range(200)]
    return (left, right, spark.createDataFrame(left, "id int, k string, t int").repartition(5),
            spark.createDataFrame(right, "k string, r int, v int, w string").repartition(3))


def rank(row):
    """Nulls first, as Spark orders them."""
    return tuple((x is not None, x if x is not None else 0 if isinstance(x, int) else "") for x in row)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("hot", [0.1, 0.8])
def test_asof_equals_all_pairs(spark, strict, hot):
    left, right, a, b = frames(spark, 5, hot)
    spark.conf.set("spark.sql.shuffle.partitions", "13")        # ranges of one key, and keys of one range
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in temporal.asof_join(a, b, ["k"], "t", "r", strict=strict).collect()]
        inner = temporal.asof_join(a, b, ["k"], "t", "r", "inner", strict).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for i, k, t in left:
        met = [m[1:] for m in right if k is not None and t is not None and m[0] == k and m[1] is not None and (m[1] < t if strict else m[1] <= t)]
        want.append((i, k, t, *(max(met, key=rank) if met else (None, None, None))))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert inner == sum(w[3] is not None for w in want)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_intervals_equal_all_pairs(spark, how):
    draw = random.Random(8)
    left, _, a, _ = frames(spark, 6, .6)
    right = []
    for i in range(150):
        start = draw.choice([None, *range(-40, 70)])
        length = draw.choice([None, -3, 0, 1, 1, 2, 3, 7, 8, 9, 30, 1 << 40, (1 << 60) + 100])
        right.append((draw.choice(["hot", "a", "b", None]), i, start, None if length is None or start is None else start + length))
    b = spark.createDataFrame(right, "k string, j int, s long, e long")
    a = a.withColumn("t", F.col("t").cast("long"))
    joined = temporal.interval_join(a, b, ["k"], "t", "s", "e", how)
    want = []
    for i, k, t in left:
        met = [m for m in right if k is not None and t is not None and m[0] == k and m[2] is not None and m[2] <= t
               and (m[3] is None or t < m[3])]
        want += [(i, k, t, *m[1:]) for m in met] or ([(i, k, t, None, None, None)] if how == "left" else [])
    assert sorted(map(tuple, joined.collect()), key=repr) == sorted(want, key=repr)
    assert "NestedLoop" not in joined._jdf.queryExecution().toString() and "Cartesian" not in joined._jdf.queryExecution().toString()


def test_dates_clashes_and_empty_tables(spark):
    day = lambda n: dt.date(2024, 1, n)
    a = spark.createDataFrame([("x", day(1)), ("x", day(9)), ("y", day(5))], "k string, d date")
    b = spark.createDataFrame([("x", day(1), day(9), 1), ("x", day(9), None, 2)], "k string, s date, e date, v int")
    rows = temporal.interval_join(a, b, ["k"], "d", "s", "e", "left").collect()
    assert sorted((r.k, r.d.day, r.v) for r in rows if r.v) == [("x", 1, 1), ("x", 9, 2)] and len(rows) == 3
    assert temporal.interval_join(a, b.limit(0), ["k"], "d", "s", "e").count() == 0
    assert temporal.asof_join(a, b.limit(0), ["k"], "d", "s").where("v IS NULL").count() == 3
    assert temporal.asof_join(a.limit(0), b, ["k"], "d", "s").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        temporal.asof_join(a, b.withColumnRenamed("v", "d"), ["k"], "d", "s")


def test_copies_of_points_are_not_broadcast(spark, tmp_path):
    """A small file of points, each copied into every width that occurs, stays off the driver."""
    points = spark.range(2000).selectExpr("id % 50 AS k", "id", "id AS t")
    spans = spark.range(300).selectExpr("id % 50 AS k", "id AS j", "id AS s", "id + (1L << CAST(id % 30 AS INT)) AS e", "uuid() AS more")
    for rows, name in ((points, "points"), (spans, "spans")):
        rows.write.parquet(str(tmp_path / name))
    joined = temporal.interval_join(spark.read.parquet(str(tmp_path / "points")), spark.read.parquet(str(tmp_path / "spans")), ["k"], "t", "s", "e")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
