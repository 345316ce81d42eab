"""Exact dedup behind a cuckoo-filter index of live digests.

The digests are dealt to shards by their own bits. Each shard keeps a cuckoo
filter (16-bit fingerprints, four to a bucket) and, as rows, its content: every
live digest with its copies and the id that stays. A digest that the filter
doesn't know is new and goes in; one that it knows is compared with the content
of that bucket. A filter that overflows is built again, twice as large, from the
stored digests. Rows are summed per task before they are dealt, so a text with a
third of all rows costs a shard one row per task.

Defined cases: a null text counts as empty; of equal texts the row with the
largest doc_id stays (null ids are least); repeated rows of that id are one
survivor in `keep_id`, `kept` holds for each of them; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import write_stage

SLOTS = 4
KICKS = 256
START_BUCKETS = 256
#: Digests that one shard should hold, about 20 MB in a task.
PER_SHARD = 100_000
LEAST_ID = -(1 << 63)

INDEX = "shard int, digest string, keep_id long, copies long, filter binary"


class CuckooFilter:
    """Approximate set of hex digests with insertion and deletion."""

    def __init__(self, buckets: int = START_BUCKETS, cells: bytes | None = None):
        self.buckets = buckets
        self.cells = (np.frombuffer(cells, np.uint16).copy() if cells is not None
                      else np.zeros(buckets * SLOTS, np.uint16)).tolist()

    def place(self, digest: str) -> tuple[int, int]:
        """First bucket and fingerprint; 0 marks an empty cell."""
        return int(digest[-12:], 16) % self.buckets, int(digest[-16:-12], 16) or 1

    def other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 % self.buckets)      # buckets: a power of two

    def __contains__(self, digest: str) -> bool:
        b, mark = self.place(digest)
        c = self.other(b, mark)
        return mark in self.cells[b * SLOTS:b * SLOTS + SLOTS] or mark in self.cells[c * SLOTS:c * SLOTS + SLOTS]

    def _put(self, bucket: int, mark: int) -> bool:
        for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.cells[i]:
                self.cells[i] = mark
                return True
        return False

    def add(self, digest: str) -> bool:
        """False if no cell was found after KICKS moves; build a larger filter then."""
        bucket, mark = self.place(digest)
        if self._put(bucket, mark) or self._put(bucket := self.other(bucket, mark), mark):
            return True
        for turn in range(KICKS):
            i = bucket * SLOTS + (mark + turn) % SLOTS
            mark, self.cells[i] = self.cells[i], mark
            bucket = self.other(bucket, mark)
            if self._put(bucket, mark):
                return True
        return False

    def remove(self, digest: str) -> None:
        """Clears one cell of a digest that is in the set."""
        b, mark = self.place(digest)
        for bucket in (b, self.other(b, mark)):
            for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.cells[i] == mark:
                    self.cells[i] = 0
                    return

    def dump(self) -> bytes:
        return np.asarray(self.cells, np.uint16).tobytes()


class Shard:
    """A filter and the content that confirms its hits."""

    def __init__(self, cells: bytes | None, rows):
        self.live: dict[str, list[int]] = {d: [keep, n] for d, keep, n in rows}
        self.filter = CuckooFilter(len(cells) // (2 * SLOTS), cells) if cells else CuckooFilter()
        self.resized = 0

    def insert(self, digest: str, keep: int, copies: int) -> None:
        if digest in self.filter and (found := self.live.get(digest)):
            found[0] = max(found[0], keep)
            found[1] += copies
            return
        self.live[digest] = [keep, copies]
        if not self.filter.add(digest):
            self.grow()

    def grow(self) -> None:
        size = self.filter.buckets
        while True:
            size, self.resized = size * 2, self.resized + 1
            self.filter = CuckooFilter(size)
            if all(self.filter.add(d) for d in self.live):
                return

    def delete(self, digest: str) -> None:
        if digest in self.filter and self.live.pop(digest, None):
            self.filter.remove(digest)


def digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("digest"))


def _summed(shards: int):
    """Per task: one row for each digest it saw, flushed when many."""
    def task(frames):
        seen: dict[str, list[int]] = {}
        for frame in frames:
            ids = frame.doc_id.to_numpy()
            for digest, i, known in zip(frame.digest, ids, frame.known):
                i = int(i) if known else LEAST_ID
                if (row := seen.get(digest)) is None:
                    seen[digest] = [i, 1]
                else:
                    row[0], row[1] = max(row[0], i), row[1] + 1
            if len(seen) > 2 * PER_SHARD:
                yield flush(seen)
                seen = {}
        if seen:
            yield flush(seen)

    def flush(seen):
        return pd.DataFrame({"shard": [int(d[:8], 16) % shards for d in seen], "digest": list(seen),
                             "keep_id": [v[0] for v in seen.values()], "copies": [v[1] for v in seen.values()]})
    return task


def update(index: DataFrame | None, inserts: DataFrame, deletes: DataFrame | None = None,
           rows: int | None = None) -> DataFrame:
    """The index after deleting every digest of ``deletes`` and then inserting ``inserts``.

    ``inserts`` has doc_id and digest, ``deletes`` digest. ``index`` is None at
    first; ``rows``, the number of documents it should hold, then sets the shards.
    The result is a staged table with a row for each live digest and one with the
    filter of each shard.
    """
    spark = inserts.sparkSession
    n = (index.where("digest IS NULL").count() if index is not None
         else max(1, -(-(rows or inserts.count()) // PER_SHARD)))
    summed = (inserts.select("digest", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"))
              .mapInPandas(_summed(n), "shard int, digest string, keep_id long, copies long"))
    changes = summed
    if deletes is not None:
        gone = deletes.select("digest").distinct()
        changes = changes.unionByName(gone.selectExpr(
            f"CAST(conv(substr(digest, 1, 8), 16, 10) % {n} AS INT) AS shard", "digest",
            "CAST(0 AS BIGINT) AS keep_id", "CAST(0 AS BIGINT) AS copies"))
    every = spark.range(n).selectExpr("CAST(id AS INT) AS shard", "CAST(NULL AS STRING) AS digest",
                                      "CAST(0 AS BIGINT) AS keep_id", "CAST(0 AS BIGINT) AS copies")
    before = index if index is not None else spark.createDataFrame([], INDEX)

    def shard(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        rows = old[old.digest.notna()]
        cells = old[old.digest.isna()]["filter"]
        state = Shard(bytes(cells.iloc[0]) if len(cells) else None,
                      zip(rows.digest, rows.keep_id.astype("int64"), rows.copies.astype("int64")))
        new = new[new.digest.notna()]
        for digest in new.digest[new.copies == 0]:
            state.delete(digest)
        new = new[new.copies > 0]
        for digest, keep, copies in zip(new.digest, new.keep_id, new.copies):
            state.insert(digest, int(keep), int(copies))
        live = state.live
        return pd.DataFrame({
            "shard": key[0], "digest": [*live, None], "keep_id": [*(v[0] for v in live.values()), 0],
            "copies": [*(v[1] for v in live.values()), 0], "filter": [None] * len(live) + [state.filter.dump()]})

    after = before.groupBy("shard").cogroup(changes.unionByName(every).groupBy("shard")).applyInPandas(shard, INDEX)
    return write_stage(after, "cuckoo-index")


def lookup(index: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, digest) with keep_id, group_size and kept."""
    live = index.where("digest IS NOT NULL").select(
        "digest", F.when(F.col("keep_id") != LEAST_ID, F.col("keep_id")).alias("keep_id"),
        F.col("copies").alias("group_size"))
    return rows.join(live, "digest").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept."""
    rows = write_stage(digests(docs), "cuckoo-digests")
    return lookup(update(None, rows), rows)
