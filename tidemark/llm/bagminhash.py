"""Near-duplicates by BagMinHash.

A document is a bag of shingles of five words; a shingle's weight is how often
it occurs. Weights are discretised to integers, and the levels 1, 2, 3, ... are
grouped into blocks of doubling width. For each shingle and block a Poisson
process throws points whose rate is the width; a point has a level within the
block and a component of the signature, and counts if the level is below the
weight. A component keeps the earliest point that reaches it. All points are
functions of shingle, block and number, so two signatures agree in a component
with exactly the probability of their weighted Jaccard similarity. A process is
left as soon as its next point is later than every component.

Bands of the signature propose candidates, and each proposed pair is verified by
the overlap of its two whole bags. Equal texts are one class with one signature.
In a bucket, every member is first compared with one hub, so a bucket costs as
many pairs as it has members. Only buckets that this leaves in several
components are looked at again: their bags are compared by an inverted list, in
blocks of bounded size where a bucket is large, and report at most a spanning
set of links. Components of all links are the groups.

Defined cases: a null text counts as empty; a text of fewer than five words is
one shingle of its words; a text without words is in no bucket, so its group is
its class; white space between words doesn't matter; ``docs`` is read several
times and must give the same rows in the same partitions, as a table does, else
this raises; the survivor of a group has
its least doc_id (null ids last); repeated rows are members of one class; an
empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_slices, components, mix64, prefix_sum, with_row_id
from tidemark.session import write_stage

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 25, 5
COMPONENTS = BANDS * ROWS
#: Characters of the bags that one block of a large bucket holds.
BLOCK_CHARS = 4_000_000
#: Members that one task compares with a hub.
STAR = 500
MEMORY = 1 << 19
#: Bytes of the texts whose signatures are made together.
BATCH_BYTES = 1 << 19
#: Rows of two numbers that are broadcast, some 50 MB; more are joined by a shuffle of the texts.
BROADCAST_ROWS = 1 << 20


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MEMORY // 4:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def bags(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes, weights and owners (places in ``texts``, ascending) of all bags."""
    split = [text.split() for text in texts]
    counts = np.array([len(w) for w in split])
    codes = np.fromiter((hashes[w] for words in split for w in words), np.uint64, counts.sum())
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)
    size = np.minimum(SHINGLE, counts)[owner]
    starts = np.flatnonzero(place + size <= counts[owner])
    key = size[starts].astype(np.uint64)
    for i in range(SHINGLE):
        inside = size[starts] > i
        key = np.where(inside, mix64(key ^ codes[np.minimum(starts + i, len(codes) - 1)]), key)
    owner = owner[starts]
    # the same shingle in two texts must count apart
    _, first, weights = np.unique(mix64(key ^ mix64(owner.astype(np.uint64))), return_index=True, return_counts=True)
    order = np.lexsort((key[first], owner[first]))
    return key[first][order], weights[order], owner[first][order]


def bag(text: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and their weights."""
    return bags([text], hashes)[:2]


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0 ** -53


def signatures(shingles: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` bags the hash of the earliest point of each component; 0 for empty bags."""
    least = np.full(n * COMPONENTS, np.inf)
    mark = np.zeros(n * COMPONENTS, np.uint64)
    # blocks: levels [0, 1), [1, 2), [2, 4), [4, 8), ... below the weight
    depth = np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1
    which = np.repeat(np.arange(len(shingles)), depth)
    block = np.arange(len(which)) - np.repeat(np.cumsum(depth) - depth, depth)
    low = np.where(block == 0, 0, 1 << np.maximum(block - 1, 0))
    width = np.where(block == 0, 1, 1 << np.maximum(block - 1, 0))
    seed = mix64(shingles[which] + block.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    bound, whose, at, number = weights[which], owner[which], np.zeros(len(which)), 0
    while len(seed):
        number += 1
        point = mix64(seed + np.uint64(number))
        at = at - np.log(_unit(point)) / width
        keep = at < least.reshape(n, COMPONENTS).max(1)[whose]
        seed, point, at, low, width, bound, whose = (v[keep] for v in (seed, point, at, low, width, bound, whose))
        other = mix64(point)
        inside = np.flatnonzero(low + (other >> np.uint64(40)).astype(np.int64) % width < bound)
        component = (other[inside] % np.uint64(COMPONENTS)).astype(np.int64) + whose[inside] * COMPONENTS
        times = at[inside]
        np.minimum.at(least, component, times)
        won = times == least[component]
        mark[component[won]] = point[inside][won]
    return mark.reshape(n, COMPONENTS)


def signature(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return signatures(shingles, weights, np.zeros(len(shingles), np.int64), 1)[0]


def overlap(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two bags."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def _numbered_rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return with_row_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("digest")), "row")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, digest, class_id, copies) and classes (digest, class_id, first_id, row, copies).

    Class ids number the texts by least doc_id, so the least class of a group holds its survivor. ``row`` is the
    place of one of its texts.
    """
    members = write_stage(_numbered_rows(docs).select("doc_id", "digest", "row"), "bag-members")
    per = (members.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.min("row").alias("row"))
           .withColumn("one", F.lit(1).cast("long")))
    numbered = prefix_sum(per, [F.col("first_id").asc_nulls_last(), F.col("digest")], "one", "class_id", "bag-classes").drop("one")
    return members.drop("row").join(numbered.select("digest", "class_id", "copies"), "digest"), numbered


def _texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """class_id and text of the ``chosen`` classes (class_id, row): broadcast if they are few, else joined by a shuffle."""
    few = chosen.count() <= BROADCAST_ROWS
    return _numbered_rows(docs).select("row", "text").join(F.broadcast(chosen) if few else chosen, "row").select("class_id", "text")


def _signed(batches):
    """class_id, characters and band keys of batches of class_id and text."""
    hashes = WordHashes()
    for batch in batches:
        ids, texts = batch.columns
        for start, stop in byte_slices(texts, BATCH_BYTES):
            block = texts.slice(start, stop - start).to_pylist()
            shingles, weights, owner = bags(block, hashes)
            marks = signatures(shingles, weights, owner, len(block)).reshape(len(block), BANDS, ROWS)
            full = np.bincount(owner, minlength=len(block)) > 0
            keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(block), 1))
            for r in range(ROWS):
                keys = mix64(keys ^ marks[:, :, r])
            ends = np.concatenate([[0], np.cumsum(np.where(full, BANDS, 0))]).astype(np.int32)
            listed = pa.ListArray.from_arrays(ends, pa.array(keys[full].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids.slice(start, stop - start), pa.array([len(t) for t in block], pa.int64()), listed],
                                             names=["class_id", "chars", "keys"])


def _verify_stars(batches):
    """Rows sorted by hub: the hub's own text comes first in each run."""
    hashes, hub, own = WordHashes(), None, None
    for batch in batches:
        for start, stop in byte_slices(batch.column(2)):
            keep = []
            for h, m, text in zip(*(c.slice(start, stop - start).to_pylist() for c in batch.columns)):
                if h == m:
                    hub, own = h, bag(text, hashes)
                elif h == hub:
                    keep.append((h, m, overlap(own, bag(text, hashes))))
            columns = list(zip(*keep)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))],
                                             names=["hub", "member", "similarity"])


def links_within(ids: list[int], bags: list[tuple], known: list[int]) -> list[tuple[int, int]]:
    """Links that join the parts of a bucket which bags of similarity SIMILAR or more hold together.

    ``known`` gives components already joined. A missing link has an end outside
    the largest of them, so only those bags are compared with all others, by an
    inverted list of shingles, counted weight by weight.
    """
    parent = {k: k for k in known}

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k
    sizes = np.array([int(w.sum()) for _, w in bags])
    shingles = np.concatenate([s for s, _ in bags])
    weights = np.concatenate([w for _, w in bags])
    owner = np.repeat(np.arange(len(bags)), [len(s) for s, _ in bags])
    order = np.lexsort((owner, shingles))
    shingles, weights, owner = shingles[order], weights[order], owner[order]
    names, members = np.unique(known, return_counts=True)
    largest, left, out = int(names[members.argmax()]), len(names), []
    for i, (s, w) in enumerate(bags):
        if left == 1:
            break
        if known[i] == largest:
            continue
        first, last = np.searchsorted(shingles, s), np.searchsorted(shingles, s, side="right")
        counts = last - first
        at = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        both = np.bincount(owner[at], np.minimum(weights[at], np.repeat(w, counts)), minlength=len(bags))
        for j in np.flatnonzero(both >= SIMILAR * (sizes[i] + sizes - both) - 1e-9):
            a, b = root(known[i]), root(known[j])
            if a != b:
                parent[a], left = b, left - 1
                out.append((ids[i], ids[j]))
    return out


def _join_bucket(frame: pd.DataFrame) -> pd.DataFrame:
    hashes = WordHashes()
    frame = frame.sort_values("class_id")
    found = links_within(frame.class_id.tolist(), [bag(t, hashes) for t in frame.text], frame.root.tolist())
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _spread(stars: DataFrame, kept: DataFrame) -> DataFrame:
    """Pairs with the member's text, a copy of the hub in front of every few thousand members."""
    counts = stars.groupBy("hub").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    salted = (stars.join(counts, "hub").withColumn("part", F.explode(F.when(
        F.col("hub") == F.col("member"), F.sequence(F.lit(0), F.col("parts") - 1))
        .otherwise(F.array(F.pmod(F.xxhash64("member"), F.col("parts")).cast("int"))))).drop("parts"))
    return (salted.join(kept.withColumnRenamed("class_id", "member"), "member")
            .repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("hub") != F.col("member"))
            .select("hub", "member", "text"))


def links(docs: DataFrame, numbered: DataFrame) -> DataFrame:
    """Links (a, b) between classes; their components are the near-duplicate groups."""
    signed = write_stage(_texts_of(docs, numbered.select("class_id", "row")).mapInArrow(_signed, "class_id long, chars long, keys array<long>"), "bag-signed")
    if signed.count() != numbered.count():
        raise ValueError("the documents changed between two readings: write them to a table first")
    rows = signed.select("class_id", "chars", F.explode("keys").alias("bucket"))
    sizes = (rows.groupBy("bucket").agg(F.min("class_id").alias("hub"), F.count("*").alias("n"), F.sum("chars").alias("all_chars"))
             .where("n > 1"))
    buckets = write_stage(rows.join(sizes, "bucket"), "bag-buckets")
    stars = buckets.select("hub", F.col("class_id").alias("member")).distinct()
    wanted = write_stage(buckets.select("class_id").distinct().join(numbered.select("class_id", "row"), "class_id"), "bag-wanted")
    kept = write_stage(_texts_of(docs, wanted), "bag-texts")
    sure = write_stage(_spread(stars, kept).mapInArrow(_verify_stars, "hub long, member long, similarity double")
                       .where(F.col("similarity") >= SIMILAR - 1e-9).select(F.col("hub").alias("a"), F.col("member").alias("b")), "bag-stars")
    roots = components(sure, "bag-roots")
    placed = (buckets.where("n > 2").join(roots, F.col("class_id") == F.col("node"), "left")
              .withColumn("root", F.coalesce("root", "class_id")).drop("node"))
    open_buckets = placed.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("bucket")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("all_chars") / BLOCK_CHARS).cast("int"))
    left = (placed.join(open_buckets, "bucket").withColumn("blocks", blocks)
            .withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")))
    more = (left.select("bucket", "i", "j", "class_id", "root").join(kept, "class_id")
            .groupBy("bucket", "i", "j").applyInPandas(_join_bucket, "a long, b long"))
    return write_stage(sure.unionByName(more), "bag-links")


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, digest, class_id, copies, group_id (least class of the group), kept.

    The survivor of a group is its document of least doc_id; if several rows carry that id and text, all of them.
    """
    members, numbered = classes(docs)
    numbered = write_stage(numbered, "bag-numbered")
    roots = components(links(docs, numbered), "bag-groups")
    firsts = numbered.select("class_id", "first_id")
    return (members.join(roots, F.col("class_id") == F.col("node"), "left").drop("node")
            .withColumn("group_id", F.coalesce("root", "class_id")).drop("root")
            .join(firsts, "class_id")
            .withColumn("kept", (F.col("group_id") == F.col("class_id")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).drop("first_id"))
