"""As-of and interval joins of two tables, without comparing all pairs of a key.

`asof_join` sorts both sides together by key and time into ranges, so that even a
key with a third of all rows is dealt over many tasks. Within a range the last
row of the right side is carried along; what a range hands to the next one of its
key is one row, found by a second pass over a row for each key and range.

`interval_join` puts intervals into buckets of a width that fits their length, a
power of two, so an interval meets at most two of them. A point looks once into
each width that occurs (63 at most), by an equality join on key, width and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import write_stage

#: Widths are 2^0 to 2^62; an interval without an end has a bucket of its own above them.
WIDEST = 62


def _same(left: DataFrame, right: DataFrame, by: list[str]) -> None:
    taken = set(left.columns) & set(right.columns) - set(by)
    if taken:
        raise ValueError(f"both sides have the columns {sorted(taken)}")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, right_time: str,
              how: str = "left", strict: bool = False) -> DataFrame:
    """Each left row with the right row of its key that is last at or before its time (before it, if ``strict``).

    Of several right rows of one key and time the greatest, column by column, counts. A left row with a null key or
    time matches none; right rows with one are ignored. ``how`` is ``left`` or ``inner``. Right columns must have
    names of their own, but for the key.
    """
    _same(left, right, by)
    if how not in ("left", "inner"):
        raise ValueError(f"unknown kind of join {how}")
    carried = [c for c in right.columns if c not in by]
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(by)]
    # rows of one key and time: the right side first, or last if only earlier ones count
    sides = (1, 0) if strict else (0, 1)
    asked = left.select(*keys, F.col(time).alias("at"), F.lit(sides[1]).alias("side"),
                        F.struct(*left.columns).alias("own"), F.lit(None).cast(right.select(F.struct(*carried)).schema[0].dataType).alias("met"))
    told = (right.where(known & F.col(right_time).isNotNull())
            .select(*keys, F.col(right_time).alias("at"), F.lit(sides[0]).alias("side"),
                    F.lit(None).cast(asked.schema["own"].dataType).alias("own"), F.struct(*carried).alias("met")))
    names = [f"k{i}" for i in range(len(by))]
    order = [*names, "at", "side", "met"]
    # equal left rows may lie anywhere in their range: a hash of the row lets ranges end among them
    dealt = (asked.unionByName(told).withColumn("salt", F.xxhash64("own"))
             .repartitionByRange(*order, "salt").withColumn("part", F.spark_partition_id()))
    both = write_stage(dealt, "asof-ranges")
    within = Window.partitionBy("part", *names).orderBy("at", "side", "met").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("last", F.last("met", ignorenulls=True).over(within)).where(F.col("own").isNotNull())
    # one row for each range and key: what the ranges before it hand on
    ends = (both.groupBy(*names, "part").agg(F.max(F.when(F.col("met").isNotNull(), F.struct("at", "met"))).alias("end")))
    earlier = Window.partitionBy(*names).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    handed = (ends.withColumn("before", F.last("end.met", ignorenulls=True).over(earlier))
              .where(F.col("before").isNotNull()).select(*names, "part", "before"))
    found = seen.join(handed, [*names, "part"], "left").withColumn("answer", F.coalesce("last", "before"))
    # a null time or key sorts among the others but matches nothing
    usable = F.col("at").isNotNull()
    for c in names:
        usable = usable & F.col(c).isNotNull()
    found = found.withColumn("answer", F.when(usable, F.col("answer")))
    if how == "inner":
        found = found.where(F.col("answer").isNotNull())
    return found.select("own.*", *(F.col(f"answer.{c}").alias(c) for c in carried))


def _number(column: Column, kind: str) -> Column:
    """Days, microseconds or the integer itself."""
    if kind == "date":
        return F.unix_date(column).cast("long")
    if kind.startswith("timestamp"):
        return F.unix_micros(column.cast("timestamp"))
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return column.cast("long")
    raise ValueError(f"intervals of {kind} are not supported")


def interval_join(left: DataFrame, right: DataFrame, by: list[str], point: str, start: str, end: str,
                  how: str = "inner") -> DataFrame:
    """Left rows with all right rows of their key whose interval ``[start, end)`` holds ``point``.

    Bounds and points are dates, timestamps or integers. A null ``end`` is open; a null ``start``, an empty interval,
    a null key or point match nothing. ``how`` is ``inner`` or ``left``. Right columns must have names of their own,
    but for the key.
    """
    _same(left, right, by)
    if how not in ("left", "inner"):
        raise ValueError(f"unknown kind of join {how}")
    if how == "left":
        # a left row without a match has none in any width, so rows are told apart by a place
        placed = write_stage(left.withColumn("__row", F.monotonically_increasing_id()), "interval-left")
        some = write_stage(interval_join(placed, right, by, point, start, end), "interval-matched")
        rest = placed.join(some.select("__row").distinct(), "__row", "left_anti")
        return some.unionByName(rest, allowMissingColumns=True).drop("__row")
    kind = left.schema[point].dataType.simpleString()
    first, last = (_number(F.col(c), right.schema[c].dataType.simpleString()) for c in (start, end))
    # the least power of two that is no shorter than the interval; its ends are at most one bucket apart
    length = last - first
    level = F.when(last.isNull(), F.lit(WIDEST + 1)).otherwise(F.ceil(F.log2(length.cast("double"))).cast("int")
                                                              + (length > 1 << 50).cast("int"))    # where doubles are too coarse
    held = (right.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start))))
            .withColumn("__level", F.greatest(F.lit(0), F.least(level, F.lit(WIDEST + 1)))))
    bucket = lambda at: F.when(F.col("__level") > WIDEST, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", at, F.col("__level")))
    laid = held.withColumn("__bucket", F.explode(F.array_distinct(F.array(bucket(first), bucket(F.coalesce(last, first + 1) - 1)))))
    # widths that occur: 64 numbers at most
    levels = sorted(r[0] for r in held.select("__level").distinct().collect())
    at = _number(F.col(point), kind)
    sought = (left.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
              .withColumn("__bucket", bucket(at)))
    inside = (F.col(point) >= F.col(start)) & (F.col(end).isNull() | (F.col(point) < F.col(end)))
    return (sought.hint("merge").join(laid, [*by, "__level", "__bucket"]).where(inside)
               .select(*left.columns, *(c for c in right.columns if c not in by)))
