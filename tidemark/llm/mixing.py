"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words; every document of the source then
has the same expected number of copies, target / source size. Documents are laid
out by size and a hash of their id, their expected copies are summed along that
order, and a document is emitted once for every integer that its interval
crosses after one random offset per source. Neighbours in the order have nearly
equal sizes, so the words taken stay close to the target.

Defined cases: a null source is a source of its own, the last one; a null text
has no words; documents without words are laid out first and share their
source's rate; a source without words has target 0 and gives no copies; equal
ids and repeated rows are separate documents; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prefix_sum, with_row_id
from tidemark.session import write_stage

WORD = r"[^\x20\x09-\x0D]+"
#: Expected copies are integers of this many fractional bits.
BITS = 24


def words(column: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, limit: float) -> DataFrame:
    """One row per source: source, source_size, n_docs, first, target.

    ``share`` times all words are dealt by weight; no source gets over ``limit``
    times its own words, and what is cut off goes to the others by weight. The
    rate per unit of weight that settles this is found by summing over sources.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = prefix_sum(per.withColumn("one", F.lit(1).cast("long")),
                        [F.col("source").asc_nulls_last()], "one", "place", "mix-sources").drop("one")
    deal = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", deal.cast("double")).withColumn("cap", limit * F.col("source_size"))
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    pot = share * (total or 0)
    rate, filled = (pot / weight if weight else 0.0), -1
    while True:
        full = F.col("cap") <= rate * F.col("weight")
        n, caps, rest = ranked.agg(F.count_if(full), F.sum(F.when(full, F.col("cap")).otherwise(0.0)),
                                   F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == filled or not rest:
            break
        filled, rate = n, (pot - caps) / rest
    return ranked.withColumn("target", F.least(F.col("cap"), rate * F.col("weight"))).drop("cap")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0,
        seed: int = 17) -> DataFrame:
    """Columns row_id, doc_id, source, size, source_size, target, copies; one row per document.

    ``row_id`` is the document's place in the scan of ``docs``.
    """
    sized = write_stage(
        with_row_id(docs.select("doc_id", "source", words("text").alias("size")), "row_id")
        .withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))),
        "mix-sized")
    targets = write_stage(source_targets(sized, weights, share, limit), "mix-targets")
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("key"), F.col("row_id")]
    laid = prefix_sum(sized.withColumn("one", F.lit(1).cast("long")), order, "one", "place", "mix-laid").drop("one", "key")
    firsts = laid.groupBy("source").agg(F.min("place").alias("first"))
    targets = targets.drop("place").join(firsts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    one = 1 << BITS
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("source"), F.lit("")))), 1, BITS // 4),
                    16, 10).cast("long")
    step = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * one + 0.5)).otherwise(0)
    targets = targets.withColumn("offset", offset).withColumn("step", step.cast("long")).withColumnRenamed("source", "s")
    start = F.col("offset") + (F.col("place") - F.col("first")) * F.col("step")
    return (laid.join(targets, F.col("source").eqNullSafe(F.col("s")))
            .withColumn("copies", F.shiftright(start + F.col("step"), BITS) - F.shiftright(start, BITS))
            .select("row_id", "doc_id", "source", "size", "source_size", "target", "copies"))


def emit(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` takes it."""
    taken = mixed.where("copies > 0").select(F.col("row_id").alias("_row"), F.col("copies").cast("int").alias("_copies"))
    out = with_row_id(docs, "_row").join(taken, "_row")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
