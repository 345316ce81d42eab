"""Similarity join of shingle sets by set relations.

A document's set holds the hashes of its distinct shingles of five words. Two
documents link if their sets' Jaccard similarity is 0.8 or more. Equal sets are
one class, and a class is compared once.

Only the first fifth of a set's tokens can be the first that it shares with a
set it links with, whatever common order is taken. Rare tokens go first. That
needs frequencies, so classes without a partner are weeded out on a quarter of
the tokens, those of the lowest hashes: a class that has a fifth of its size
among them that no other class has can link with none. The frequencies of all
tokens are then counted over the classes left, tokens of a single class are left
out, and the others of the first fifth become lists of an index: token, class,
size and position.

The join follows the relations between sets at both levels:

* Index: the entries of a list form blocks of equal size and position. Of two
  blocks it is known from these numbers alone whether any of their members can
  still link, and pairs of blocks that can't are skipped whole, entries unread.
* Answers: in every list one class is the hub and meets all others, so a list of
  copies costs as many pairs as it has entries. A class that links with its hub
  keeps only the difference to it. Another class that meets the members of a hub
  is compared with the hub once; the answer for a member is that answer plus what
  the difference adds and less what it takes away, and often the size of the
  difference alone decides.

Classes that links already join are not compared again, as components are asked
for: after a few rounds of hubs, only blocks of different components in a list
meet. Work is joins and groupings by token and class; lists that many classes
share are summed before they are shuffled, and never held by one task.

Defined cases: a null text counts as empty; a text of fewer than five words is
one shingle of all its words; a text without words links with nothing and is its
own component, even beside others like it; white space doesn't matter; repeated
rows are one class; a component's id is its least doc_id, nulls last; a null id
is otherwise an id like others; an empty table gives none. A long text is hashed
in parts of bounded size. Other columns than id and text are not looked at and
not returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_slices, components, mix64, with_row_id
from tidemark.session import write_stage

SHINGLE = 5
#: Tokens below this hash, a quarter, are looked at in the first pass.
HEAD = np.uint64(1 << 62)
#: Rounds in which each list's hub meets the rest of the list.
HUBS = 3
#: Rows of two numbers that are broadcast, some 50 MB; more are joined by a shuffle of the texts.
BROADCAST_ROWS = 1 << 20
#: Bytes of text that are hashed at a time.
PART_BYTES = 1 << 20

#: White space between words, and a random number for each other byte, the same for A-Z as for a-z.
SPACES = (0x20, *range(0x09, 0x0E))
VALUES = mix64(np.arange(1, 257, dtype=np.uint64))
VALUES[0x41:0x5B] = VALUES[0x61:0x7B]
VALUES[list(SPACES)] = 0
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Odd factors of the words of a shingle.
FACTORS = mix64(np.arange(1000, 1000 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of ``data``, by a polynomial over its bytes."""
    values = VALUES[data]
    solid = values != 0
    starts = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = np.diff(np.append(starts, len(data)))
    within = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(lengths.max(), BASE))
    return mix64(np.add.reduceat(values[starts[0]:] * powers[within], starts - starts[0])), starts


def parts(text: bytes):
    """A long text in parts that end behind a word."""
    data, at = np.frombuffer(text, np.uint8), 0
    while at < len(data):
        stop = at + PART_BYTES
        while stop < len(data):
            gaps = np.flatnonzero(VALUES[data[stop:stop + PART_BYTES]] == 0)
            if len(gaps):
                stop += int(gaps[0])
                break
            stop += PART_BYTES
        yield data[at:stop]
        at = stop


def _set(words: np.ndarray) -> np.ndarray:
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    count = len(words) - size + 1
    mixed = sum(words[i:i + count] * FACTORS[i] for i in range(size))
    return np.unique(mix64(mixed + np.uint64(size)))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    if len(texts) == 1:
        return [_set(np.concatenate([word_hashes(p)[0] for p in parts(texts[0])] or [np.zeros(0, np.uint64)]))]
    words, starts = word_hashes(np.frombuffer(b"\n".join(texts), np.uint8))
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts])
    cut = np.searchsorted(starts, firsts)
    return [_set(words[a:b]) for a, b in zip(cut, cut[1:])]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


def _sets(docs: DataFrame, whole: bool) -> DataFrame:
    """Rows with n and tokens: all of them, or the digest of all and those of the first quarter."""
    at = docs.schema.fieldNames().index("text")
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def task(batches):
        for batch in batches:
            for start, stop in byte_slices(batch.column(at), PART_BYTES):
                part = batch.slice(start, stop - start)
                own = [c for i, c in enumerate(part.columns) if i != at]
                sets = shingle_sets(pc.fill_null(part.column(at), "").cast(pa.binary()).to_pylist())
                n = pa.array([len(s) for s in sets], pa.int64())
                if whole:
                    made = [n, _lists(sets)]
                else:
                    digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                    made = [n, digests, _lists([s[:np.searchsorted(s, HEAD)] for s in sets])]
                yield pa.RecordBatch.from_arrays([*own, *made], names=[*(f.name for f in kept), "n", *([] if whole else ["digest"]), "tokens"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(task, f"{schema}, n long, {'' if whole else 'digest binary, '}tokens array<long>")


def first_part() -> Column:
    """How many tokens can be the first common one with a linked set: n - ceil(0.8 n) + 1."""
    return F.expr("n - (80 * n + 99) div 100 + 1")


def linked(both, a, b):
    """100 times the common tokens is at least 80 times all of both sets."""
    return 9 * both >= 4 * (a + b)


def _left_over(sets: DataFrame) -> DataFrame:
    """A row for each class that may link: those without a fifth of their size of tokens that no other row has.

    Rows of one class have no tokens of their own, so a repeated text always stays, once.
    """
    head = sets.select("row", F.explode("tokens").alias("token"))
    shared = head.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1").select("token")
    known = head.join(shared, "token", "left_semi").groupBy("row").agg(F.count("*").alias("shared"))
    own = F.col("held") - F.coalesce("shared", F.lit(0))
    return (sets.where("n > 0").select("row", "mark", "digest", "n", F.size("tokens").alias("held"))
            .join(known, "row", "left").where(own < first_part())
            .groupBy("digest").agg(F.min(F.struct("row", "mark")).alias("first")).select("first.row", "first.mark"))


def _ranked(sets: DataFrame) -> DataFrame:
    """cid, n, own (tokens of no other class), tokens: the others, rare ones first."""
    every = sets.select("cid", "n", F.explode("tokens").alias("token"))
    counts = every.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    return (every.join(counts, "token").groupBy("cid", "n")
            .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"))
            .select("cid", "n", (F.col("n") - F.size("ranked")).alias("own"), F.col("ranked.token").alias("tokens")))


def _index(ranked: DataFrame) -> DataFrame:
    """Lists: token, cid, n, pos."""
    reach = (first_part() - F.col("own")).cast("int")
    entries = ranked.where(reach > 0).select("cid", "n", "own", F.posexplode(F.slice("tokens", F.lit(1), reach)).alias("at", "token"))
    index = entries.select("token", "cid", "n", (F.col("own") + F.col("at")).alias("pos"))
    several = index.groupBy("token").agg(F.count("*").alias("entries")).where("entries > 1").select("token")
    return index.join(several, "token")


def may_link(n: Column, pos: Column, m: Column, other: Column) -> Column:
    """Whether sets of these sizes, whose first common token has these positions, can have enough in common."""
    return linked(1 + F.least(n - pos - 1, m - other - 1), n, m)


def _rooted(index: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries of lists that hold several components, with ``root`` and whether it is the list's ``main`` one."""
    placed = index.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    per = placed.groupBy("token", "root").agg(F.count("*").alias("entries"))
    lists = (per.groupBy("token").agg(F.max(F.struct("entries", "root")).alias("main"), F.count("*").alias("parts"))
             .where("parts > 1").select("token", F.col("main.root").alias("main")))
    return placed.join(lists, "token").withColumn("main", F.col("root") == F.col("main"))


def _with_hubs(entries: DataFrame) -> DataFrame:
    """Pairs (a, b) of each list's hub, the least class outside the main component, and its other entries."""
    hubs = (entries.where("NOT main").groupBy("token").agg(F.min(F.struct("cid", "n", "pos", "root")).alias("h")))
    return (entries.join(hubs, "token").where(F.col("root") != F.col("h.root"))
            .where(may_link(F.col("n"), F.col("pos"), F.col("h.n"), F.col("h.pos")))
            .select(F.col("h.cid").alias("a"), F.col("cid").alias("b")).distinct())


def _between_blocks(entries: DataFrame) -> DataFrame:
    """Pairs (a, b) of all entries of different components in a list, by blocks of equal size and position."""
    block = ["token", "n", "pos", "root"]
    blocks = entries.groupBy(*block, "main").agg(F.count("*").alias("entries"))
    other = blocks.select("token", *(F.col(c).alias(f"_{c}") for c in block[1:]), F.col("main").alias("_main"))
    met = (blocks.where("NOT main").join(other, "token")
           .where((F.col("root") != F.col("_root")) & (F.col("_main") | (F.col("root") < F.col("_root"))))
           .where(may_link(F.col("n"), F.col("pos"), F.col("_n"), F.col("_pos"))).select(*block, *(f"_{c}" for c in block[1:])))
    left = entries.select(*block, F.col("cid").alias("a"))
    right = entries.select("token", *(F.col(c).alias(f"_{c}") for c in block[1:]), F.col("cid").alias("b"))
    return met.join(left, block).join(right, ["token", *(f"_{c}" for c in block[1:])]).select("a", "b").distinct()


def _common(pairs: DataFrame, ranked: DataFrame) -> DataFrame:
    """Pairs (a, b) with both sizes and token lists."""
    side = lambda c: ranked.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(f"t_{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a")


def _from_hubs(pairs: DataFrame, ranked: DataFrame) -> DataFrame:
    """Links (hub, cid) among the pairs (a: hub, b), with what the class has more (``plus``) and less (``minus``)."""
    met = _common(pairs, ranked).withColumn("both", F.size(F.array_intersect("t_a", "t_b")))
    return (met.where(linked(F.col("both"), F.col("n_a"), F.col("n_b")))
            .select(F.col("a").alias("hub"), F.col("b").alias("cid"), F.col("n_b").alias("n"),
                    F.array_except("t_b", "t_a").alias("plus"), F.array_except("t_a", "t_b").alias("minus")))


def _derived(pairs: DataFrame, ranked: DataFrame, stars: DataFrame) -> DataFrame:
    """Links among pairs (a, b): b's answer comes from its hub's, where it has one."""
    chosen = stars.groupBy("cid").agg(F.min("hub").alias("hub"))
    answers = stars.join(chosen, ["cid", "hub"]).select(F.col("cid").alias("b"), "hub", "plus", "minus")
    asked = (pairs.join(answers, "b", "left").withColumn("base", F.coalesce("hub", "b"))
             .join(ranked.select(F.col("cid").alias("b"), F.col("n").alias("n_b")), "b"))
    bases = asked.select("a", "base").distinct().where("a <> base")
    met = (_common(bases.withColumnRenamed("base", "b"), ranked)
           .select("a", F.col("b").alias("base"), F.col("n_a"), F.size(F.array_intersect("t_a", "t_b")).alias("both")))
    # a class that is itself the hub of b: they linked or not when the hub met its list
    told = asked.join(met, ["a", "base"])
    least = F.col("both") - F.coalesce(F.size("minus"), F.lit(0))
    most = F.col("both") + F.coalesce(F.size("plus"), F.lit(0))
    bounded = (told.where(linked(most, F.col("n_a"), F.col("n_b")))
               .withColumn("sure", linked(least, F.col("n_a"), F.col("n_b"))))
    sure = bounded.where("sure").select("a", "b")
    exact = (bounded.where("NOT sure").join(ranked.select(F.col("cid").alias("a"), "tokens"), "a")
             .withColumn("both", F.col("both") - F.size(F.array_intersect("tokens", "minus")) + F.size(F.array_intersect("tokens", "plus"))))
    return sure.unionByName(exact.where(linked(F.col("both"), F.col("n_a"), F.col("n_b"))).select("a", "b"))


def links(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """Links (a, b) between classes whose components are those of all links."""
    spark = index.sparkSession
    found = spark.createDataFrame([], "a long, b long")
    roots = spark.createDataFrame([], "node long, root long")
    stars = spark.createDataFrame([], "hub long, cid long, n long, plus array<long>, minus array<long>")
    for _ in range(HUBS):
        entries = write_stage(_rooted(index, roots), "set-lists")
        if entries.isEmpty():
            return found
        new = write_stage(_from_hubs(_with_hubs(entries), ranked), "set-stars")
        stars = stars.unionByName(new)
        found = found.unionByName(new.select(F.col("hub").alias("a"), F.col("cid").alias("b")))
        roots = components(found, "set-roots")
    entries = write_stage(_rooted(index, roots), "set-lists")
    if entries.isEmpty():
        return found
    return found.unionByName(write_stage(_derived(_between_blocks(entries), ranked, stars), "set-links"))


def join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (least doc_id of equal sets), component_id.

    ``docs`` is read twice and must give the same rows in the same partitions, as a table does; if not, this raises.
    """
    told = with_row_id(docs.select("doc_id", "text", F.xxhash64("text").alias("mark")), "row")
    sets = write_stage(_sets(told, whole=False), "set-heads")
    left = write_stage(_left_over(sets), "set-left")
    classes = left.count()
    wanted = left.withColumnRenamed("mark", "_mark")
    again = (told.join(F.broadcast(wanted) if classes <= BROADCAST_ROWS else wanted, "row").where("mark = _mark")
             .select(F.col("row").alias("cid"), "text"))
    whole = write_stage(_sets(again, whole=True), "set-whole")
    if whole.count() != classes:
        raise ValueError("the documents changed between two readings: write them to a table first")
    ranked = write_stage(_ranked(whole), "set-ranked")
    index = write_stage(_index(ranked), "set-index")
    roots = components(links(index, ranked), "set-components")
    firsts = sets.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.min("row").alias("cid"))
    placed = firsts.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    ids = placed.groupBy("root").agg(F.min("class_id").alias("component_id"))
    classes = placed.join(ids, "root").select("digest", "class_id", "component_id")
    some = sets.where("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "digest").join(classes, "digest").drop("digest")
    none = sets.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("class_id"),
                                      F.col("doc_id").alias("component_id"))
    return some.unionByName(none)
