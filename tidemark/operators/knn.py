"""Exact nearest neighbours without comparing all pairs.

Donors are split into cells of a k-d tree whose cuts come from a bounded
sample; the sample decides only where work goes, never the answer. A first
round searches each query's own cell and yields an upper bound on its k-th
distance. A second round sends the query only to the other cells whose
bounding box lies within that bound. Queries of one place leave out together
the boxes that none of them can reach, so a query meets few boxes however many
cells there are. Inside a task the same two steps are repeated on small leaves,
so a query meets few donors even in a full cell.
Equal donors are one row with a count, so copies cannot swell a cell, and a
cell is searched in parts of bounded size.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import write_stage

CELL_DONORS = 16_384        # donors a cell should hold
MAX_CELLS = 65_536          # cells per class; their boxes are listed on the driver
SAMPLE_DONORS = 262_144     # donors sampled per class to place the cuts
PART_QUERIES = 32_768       # rows handled together by one search
PART_DONORS = 131_072
LEAF_DONORS = 256           # donors compared at once inside a search
GAP_CELLS = 4_000_000       # entries of one query-by-box table
CELL = ["cls", "leaf"]
MAX_PARTS = 65_536          # parts of a cell, more than there ever are


# --- cells ------------------------------------------------------------------

def _grow(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut dimension and cut value of every inner node, in level order."""
    dims = np.zeros(2 ** depth - 1, dtype=int)
    cuts = np.zeros(2 ** depth - 1)
    members = {0: points}
    for node in range(2 ** depth - 1):
        part = members.pop(node)
        if len(part):
            dims[node] = np.argmax(np.ptp(part, axis=0))
            along = part[:, dims[node]]
            middle = (len(along) - 1) // 2
            cuts[node] = np.partition(along, middle)[middle]
            # many donors may share the largest value: cut just below it
            if cuts[node] == along.max() > along.min():
                cuts[node] = along[along < along.max()].max()
        right = part[:, dims[node]] > cuts[node]
        members[2 * node + 1], members[2 * node + 2] = part[~right], part[right]
    return dims, cuts


def _descend(tree, points: np.ndarray) -> np.ndarray:
    dims, cuts = tree
    node = np.zeros(len(points), dtype=int)
    rows = np.arange(len(points))
    for _ in range(int(np.log2(len(dims) + 1))):
        node = 2 * node + 1 + (points[rows, dims[node]] > cuts[node])
    return node - len(dims)


def _fit_cells(donors: DataFrame, rows: dict[int, int] | None = None) -> dict:
    """A tree of cuts for each class; ``rows``: at least its number of donors, counted if not given."""
    if rows is None:
        rows = {r["cls"]: r["count"] for r in donors.groupBy("cls").count().collect()}
    shares = {cls: min(1.0, SAMPLE_DONORS / max(1, size)) for cls, size in rows.items()}
    share = reduce(lambda acc, item: acc.when(F.col("cls") == item[0], F.lit(item[1])),
                   shares.items(), F.when(F.lit(False), F.lit(0.0)))
    drawn = F.pmod(F.xxhash64("vec", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20)
    sample = donors.where(drawn).select("cls", "vec").toArrow()
    drawn_cls, drawn_vec = sample["cls"].to_numpy(), _matrix(sample["vec"])
    trees = {}
    for cls in rows:
        points = drawn_vec[drawn_cls == cls]
        size = len(points) / shares[cls]        # copies are drawn once
        depth = int(np.ceil(np.log2(max(1, min(MAX_CELLS, size / CELL_DONORS)))))
        trees[cls] = _grow(points, depth)
    return trees


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column, all of one length, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _with_leaf(df: DataFrame, trees: dict) -> DataFrame:
    @F.arrow_udf("int")
    def leaf(cls: pa.Array, vec: pa.Array) -> pa.Array:
        cls, points = cls.to_numpy(zero_copy_only=False), _matrix(vec)
        out = np.zeros(len(cls), dtype=np.int32)
        for key in np.unique(cls):
            if key in trees:
                out[cls == key] = _descend(trees[key], points[cls == key])
        return pa.array(out)

    return df.withColumn("leaf", leaf("cls", "vec"))


def _boxes(donors: DataFrame, width: int) -> dict:
    """Cells, their lower and upper corners and their sizes in rows; MAX_CELLS per class at most."""
    bounds = [f(F.col("vec")[i]) for f in (F.min, F.max) for i in range(width)]
    rows = donors.groupBy(*CELL).agg(F.array(*bounds).alias("box"), F.sum("n").alias("size")).collect()
    boxes: dict = {}
    for row in rows:
        boxes.setdefault(row["cls"], []).append((row["leaf"], row["box"], row["size"]))
    return {cls: (np.array([c[0] for c in cells]), np.array([c[1][:width] for c in cells]),
                  np.array([c[1][width:] for c in cells]), np.array([c[2] for c in cells]))
            for cls, cells in boxes.items()}


# --- search -----------------------------------------------------------------

def _gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance from each point to each box."""
    gap = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        x = points[:, j, None]
        gap += np.maximum(np.maximum(low[:, j] - x, x - high[:, j]), 0) ** 2
    return gap


def _groups(keys: np.ndarray) -> dict[int, np.ndarray]:
    """Positions of each key."""
    order = np.argsort(keys, kind="stable")
    found, first = np.unique(keys[order], return_index=True)
    return dict(zip(found.tolist(), np.split(order, first[1:])))


def _reachable(points, low, high, factor, bound, groups):
    """Pairs (point, box) closer than each point's bound.

    A group of points that lie together first leaves out the boxes that none of
    them can reach, so that a point meets few boxes however many there are.
    """
    bound = bound * (1 + 1e-9)
    found = [(np.zeros(0, dtype=int), np.zeros(0, dtype=int))]
    for rows in groups:
        lowest, highest = points[rows].min(axis=0), points[rows].max(axis=0)
        apart = np.maximum(np.maximum(low - highest, lowest - high), 0)
        near = np.nonzero((apart ** 2).sum(axis=1) * factor <= bound[rows].max())[0]
        step = max(1, GAP_CELLS // max(1, len(near)))
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            row, box = np.nonzero(_gaps(points[some], low[near], high[near]) * factor <= bound[some, None])
            found.append((some[row], near[box]))
    row, box = (np.concatenate(part) for part in zip(*found))
    return row, box


def _certain(points, low, high, factor):
    """For each point a distance within which one of the boxes lies whole."""
    out = np.full(len(points), np.inf)
    step = max(1, GAP_CELLS // max(1, len(low)))
    for at in range(0, len(points) if len(low) else 0, step):
        far = np.zeros((len(points[at:at + step]), len(low)))
        for j in range(points.shape[1]):
            x = points[at:at + step, j, None]
            far += np.maximum(x - low[:, j], high[:, j] - x) ** 2
        out[at:at + step] = far.min(axis=1) * factor
    return out


def _before(row, n):
    """Sum of ``n`` over the entries of the same row that come before; entries are in order of rows."""
    before = np.cumsum(n) - n
    counts = np.bincount(row)
    return before - np.repeat(before[(np.cumsum(counts) - counts)[counts > 0]], counts[counts > 0])


def _ordered(row, dist, value):
    """Order by row, distance and value: by distance first, then by row, and rows with equal distances once more."""
    order = np.argsort(dist)
    key = row.astype(np.uint16) if len(row) and row.max() < 1 << 16 else row        # these are sorted by digits
    order = order[np.argsort(key[order], kind="stable")]
    r, d = row[order], dist[order]
    tied = r[1:][(r[1:] == r[:-1]) & (d[1:] == d[:-1])]
    if len(tied):
        again = np.zeros(r[-1] + 1, dtype=bool)
        again[tied] = True
        again = again[r]
        some = order[again]
        order[again] = some[np.lexsort((value[some], dist[some], row[some]))]
    return order


def _first_k(row, dist, value, donor, k):
    """The k best entries of each row: by distance, then by value."""
    order = _ordered(row, dist, value)
    order = order[_before(row[order], np.ones(len(row), dtype=int)) < k]
    return row[order], dist[order], value[order], donor[order]


def _compare(points, rows, others, members, values, k, factor, bound, first):
    """Entries of a few points and one leaf within the points' bounds, in any order; the ``first`` leaf sets the bounds."""
    dist = np.zeros((len(rows), len(members)))
    for x, y in zip(points[rows].T, others[members].T):
        gap = np.subtract.outer(x, y)
        gap *= gap
        dist += gap
    dist *= factor
    if first and len(members) >= k:
        bound[rows] = np.partition(dist, k - 1, axis=1)[:, k - 1]
    row, col = np.nonzero(dist <= bound[rows, None])
    found = row, dist[row, col], values[members[col]], members[col]
    if len(row) > 2 * k * len(rows):        # many equal distances
        found = _first_k(*found, k)
    return rows[found[0]], *found[1:]


def _local(points, others, values, k, factor, bound=None):
    """The k nearest donors of each point, if a bound is given those within it: (row, distance, value, donor) arrays."""
    used = np.ptp(np.concatenate([points, others]), axis=0) > 0
    points, others = points[:, used], others[:, used]
    depth = int(np.ceil(np.log2(max(1, len(others) / LEAF_DONORS)))) if used.any() else 0
    tree = _grow(others, depth) if depth else (np.zeros(0, dtype=int), np.zeros(0))
    members, own = _groups(_descend(tree, others)), _descend(tree, points)
    at_home = _groups(own)
    found = []
    if bound is None:
        bound = np.full(len(points), np.inf)
        found = [_compare(points, rows, others, members[leaf], values, k, factor, bound, True)
                 for leaf, rows in at_home.items() if leaf in members]
    else:
        own = np.full(len(points), -1)      # no leaf is known yet
    leaves = np.array(list(members))
    if len(leaves) > 1 or not found:
        low = np.array([others[rows].min(axis=0) for rows in members.values()])
        high = np.array([others[rows].max(axis=0) for rows in members.values()])
        row, box = _reachable(points, low, high, factor, bound, at_home.values())
        elsewhere = leaves[box] != own[row]
        row, box = row[elsewhere], box[elsewhere]
        found += [_compare(points, row[at], others, members[leaves[b]], values, k, factor, bound, False)
                  for b, at in _groups(box).items()]
    if not found:
        return np.zeros(0, dtype=int), np.zeros(0), values[:0], np.zeros(0, dtype=int)
    return _first_k(*(np.concatenate(part) for part in zip(*found)), k)


def _lists(row, count, arrays, names=None):
    """Arrow lists, one for each of ``count`` rows, of entries in order of rows."""
    entries = pa.StructArray.from_arrays([pa.array(a) for a in arrays], names) if names else pa.array(arrays)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(count + 1)).astype(np.int32)), entries)


def _search(queries: DataFrame, donors: DataFrame, k: int, factors: dict, value_type: str, boxes: dict) -> DataFrame:
    """Best donors of each query within the cell it was sent to.

    Queries with a ``bound`` get the donors within it. Those without get one
    here, and with it the other ``cells`` that they have to be sent to.
    """
    again = "bound" in queries.columns
    parts = (
        queries.groupBy(*CELL).agg(F.count("*").alias("nq"))
        .join(donors.groupBy(*CELL).agg(F.count("*").alias("nd")), CELL, "left")
        .select(*CELL, F.ceil(F.col("nq") / PART_QUERIES).alias("qparts"),
                F.ceil(F.coalesce("nd", F.lit(1)) / PART_DONORS).alias("dparts"))
    )
    parts = F.broadcast(parts)          # one row per cell
    # one number for cell and parts: rows are sorted by it alone, and by its digits
    part = (((F.col("cls").cast("long") * MAX_CELLS + F.col("leaf")) * MAX_PARTS + F.col("qpart")) * MAX_PARTS
            + F.col("dpart")).alias("part")
    spread_q = (queries.join(parts, CELL)
                .withColumn("qpart", F.pmod(F.xxhash64("qid"), F.col("qparts")))
                .withColumn("dpart", F.explode(F.sequence(F.lit(0), F.col("dparts") - 1)))
                .select(part, *CELL, "qid", "vec", *["bound"] * again))
    spread_d = (donors.join(parts, CELL)
                .withColumn("dpart", F.pmod(F.xxhash64("vec", "value"), F.col("dparts")))
                .withColumn("qpart", F.explode(F.sequence(F.lit(0), F.col("qparts") - 1)))
                .select(part, "vec", "value", "n"))

    def best(q: pa.Table, d: pa.Table) -> pa.Table:
        size, names = q.num_rows, ["d", "value", "n"]
        cls, leaf = (q[c][0].as_py() if size else None for c in CELL)
        if cls not in boxes:
            q, size = q.slice(0, 0), 0
        qid, points, values = q["qid"], _matrix(q["vec"]), d["value"].to_numpy()
        row, dist, donor = np.zeros(0, dtype=int), np.zeros(0), np.zeros(0, dtype=int)
        value = values[:0]
        if size and d.num_rows:
            row, dist, value, donor = _local(points, _matrix(d["vec"]), values, k, factors[cls],
                                             q["bound"].to_numpy() if again else None)
        n = d["n"].to_numpy()[donor]
        keep = _before(row, n) < k
        row, dist, value, n = row[keep], dist[keep], value[keep], n[keep]
        found = _lists(row, size, [dist, value, n], names)
        if again:
            return pa.table({"qid": qid, "found": found})
        full = np.bincount(row, n, size) >= k
        bound = np.full(size, np.inf)
        bound[full] = dist[np.searchsorted(row, np.nonzero(full)[0], side="right") - 1]
        at, cells = row[:0], np.zeros(0, dtype=np.int32)
        if size:
            leaves, low, high, sizes = boxes[cls]
            bound[~full] = _certain(points[~full], low[sizes >= k], high[sizes >= k], factors[cls])
            tree = _grow(points, int(np.ceil(np.log2(max(1, size / LEAF_DONORS)))))
            at, box = _reachable(points, low, high, factors[cls], bound, _groups(_descend(tree, points)).values())
            order = np.argsort(at, kind="stable")
            at, cells = at[order], leaves[box[order]].astype(np.int32)
            at, cells = at[cells != leaf], cells[cells != leaf]
        sent = np.unique(at)            # only these are searched again and need their vector
        width = points.shape[1]
        return pa.table({"qid": qid, "found": found, "cls": pa.array(np.full(size, cls or 0, dtype=np.int32)),
                         "vec": _lists(np.repeat(sent, width), size, points[sent].ravel()),
                         "bound": pa.array(bound), "cells": _lists(at, size, cells)})

    more = "" if again else ", cls int, vec array<double>, bound double, cells array<int>"
    return spread_q.groupBy("part").cogroup(spread_d.groupBy("part")).applyInArrow(
        best, f"qid long, found array<struct<d:double,value:{value_type},n:long>>{more}")


def _flat(found: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row number and entry of all entries of a list column."""
    return np.repeat(np.arange(len(found)), found.value_lengths().to_numpy(zero_copy_only=False)), found.flatten()


def _merged(candidates: DataFrame, k: int, value_type: str) -> DataFrame:
    """Candidates of a query in order, as many as hold k rows, whatever the parts searched."""
    kind = f"array<struct<d:double,value:{value_type},n:long>>"

    @F.arrow_udf(kind)
    def merge(lists: pa.Array) -> pa.Array:
        query, inner = _flat(lists)
        row, entries = _flat(inner)
        row = query[row]
        d, value, n = (entries.field(c).to_numpy(zero_copy_only=False) for c in ("d", "value", "n"))
        order = _ordered(row, d, value)
        order = order[_before(row[order], n[order]) < k]
        return _lists(row[order], len(lists), [d[order], value[order], n[order]], ["d", "value", "n"])

    lists = candidates.where(F.size("found") > 0).groupBy("qid").agg(F.collect_list("found").alias("lists"))
    return lists.select("qid", merge("lists").alias("found"))


def nearest(queries: DataFrame, donors: DataFrame, k: int, factors: dict[int, float],
            value_type: str = "double", rows: dict[int, int] | None = None) -> DataFrame:
    """``qid`` and ``found``: an ordered array of (d, value, n) holding the k nearest.

    ``queries`` has ``qid, cls, vec`` and may list a query under several
    classes; ``donors`` has ``cls, vec, value, n`` with distinct rows. ``d`` is
    the squared distance times the class factor. Equal distances are ordered by
    value. ``found`` may run past the k-th neighbour; readers stop there.
    ``rows``: how many rows of each class the donors were gathered from, if
    known; they are then written once, with their cells.
    """
    if rows is None:
        donors = write_stage(donors, "knn-donors")
        trees = _fit_cells(donors)
    else:
        trees = _fit_cells(donors, rows)
    donors = write_stage(_with_leaf(donors, trees), "knn-cells")
    first = donors.select("vec").first()
    if first is None:
        return queries.select("qid").limit(0).withColumn(
            "found", F.array().cast(f"array<struct<d:double,value:{value_type},n:long>>"))
    boxes = _boxes(donors, len(first.vec))
    queries = write_stage(_with_leaf(queries, trees), "knn-queries")
    own = write_stage(_search(queries, donors, k, factors, value_type, boxes), "knn-own")
    # by its class's distances each query knows which other cells may hold a nearer donor;
    # if its own cell was searched in parts, each part names them
    routed = write_stage(
        own.select("qid", "cls", "vec", "bound", F.explode("cells").alias("leaf"))
        .groupBy("qid", *CELL).agg(F.first("vec").alias("vec"), F.min("bound").alias("bound")), "knn-routes")
    rest = _search(routed, donors, k, factors, value_type, boxes)
    return _merged(own.select("qid", "found").unionByName(rest), k, value_type)


# --- neighbour means --------------------------------------------------------

def _take_mean(found: Column, k: int) -> Column:
    @F.arrow_udf("double")
    def mean(found: pa.Array) -> pa.Array:
        row, entries = _flat(found)
        value, n = (entries.field(c).to_numpy(zero_copy_only=False) for c in ("value", "n"))
        taken = np.clip(k - _before(row, n), 0, n)
        return pa.array(np.bincount(row, value * taken, len(found)) / np.bincount(row, taken, len(found)))

    return mean(found)


def knn_mean(df: DataFrame, fit: DataFrame, columns: list[str], targets: list[str], k: int,
             key: str = "id_solicitud") -> DataFrame:
    """Mean of each target over the k nearest fit rows that have it.

    The distance uses the coordinates both rows have, scaled up by the share
    that is missing. Rows are therefore grouped by which coordinates the pair
    shares: within such a class the scaling is one constant and the distance an
    ordinary Euclidean one. Returns ``key`` and ``knn_<target>`` for rows of
    ``df`` missing at least one target.
    """
    def masked(frame):
        present = reduce(lambda a, b: a.bitwiseOR(b), [
            F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0))
            for i, c in enumerate(columns)])
        return frame.withColumn("mask", present)

    rows, pool = masked(df), masked(fit)
    patterns = [m for (m,) in rows.select("mask").distinct().collect()]       # 2 ** columns at most
    pool_sizes = {r["mask"]: r["count"] for r in pool.groupBy("mask").count().collect()}
    pool_patterns = list(pool_sizes)
    classes = {}
    for t, r, d in product(range(len(targets)), patterns, pool_patterns):
        bit = 1 << columns.index(targets[t])
        if not r & bit and d & bit and r & d:
            classes.setdefault((t, r, r & d), len(classes))
    factors = {cls: len(columns) / bin(shared).count("1") for (_, _, shared), cls in classes.items()}

    def listed(frame, here, chosen):
        """Each row once per class it belongs to, with the coordinates shared in that class."""
        places = [(m, t, shared, cls) for m in here for (t, r, shared), cls in classes.items() if chosen(m, t, r, shared)]
        links = frame.sparkSession.createDataFrame(places, "mask int, t int, shared int, cls int")
        shared = [F.when(F.col("shared").bitwiseAND(F.lit(1 << i)) != 0, F.col(c).cast("double")).otherwise(F.lit(0.0))
                  .alias(f"x{i}") for i, c in enumerate(columns)]
        return frame.join(F.broadcast(links), "mask").select("*", *shared)      # as many links as pairs of masks at most

    if not classes:
        empty = df.select(key).limit(0)
        return empty.withColumns({f"knn_{c}": F.lit(None).cast("double") for c in targets})
    xs = [f"x{i}" for i in range(len(columns))]
    vec = F.array(*xs).alias("vec")
    # a query is one row and one target; its id packs both
    queries = (listed(rows.select(F.col(key).alias("key"), *columns, "mask"), patterns, lambda m, t, r, s: m == r)
               .select((F.col("key") * len(targets) + F.col("t")).alias("qid"), "cls", vec))
    values = F.element_at(F.array(*[F.col(c).cast("double") for c in targets]), F.col("t") + 1)
    donors = (listed(pool.select(*columns, "mask"), pool_patterns,
                     lambda m, t, r, s: m & 1 << columns.index(targets[t]) and m & r == s)
              .groupBy("cls", *xs, values.alias("value")).agg(F.count("*").alias("n"))
              .select("cls", vec, "value", "n"))
    sizes = {cls: sum(n for m, n in pool_sizes.items() if m & 1 << columns.index(targets[t]) and m & r == shared)
             for (t, r, shared), cls in classes.items()}
    found = nearest(queries, donors, k, factors, rows=sizes)
    mean = found.select(
        F.expr(f"qid div {len(targets)}").alias(key),
        F.pmod("qid", F.lit(len(targets))).alias("t"), _take_mean(F.col("found"), k).alias("mean"))
    return mean.groupBy(key).agg(*[
        F.max(F.when(F.col("t") == t, F.col("mean"))).alias(f"knn_{c}") for t, c in enumerate(targets)])
