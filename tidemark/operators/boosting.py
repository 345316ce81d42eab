"""Gradient-boosted trees of many settings side by side: a task a setting, over binned columns.

The fits are those of Spark's GBTClassifier (log loss on labels -1 and 1, variance trees of 32 bins grown level by level),
but a level of a tree costs array work instead of Spark jobs. Columns are binned in parallel, a byte a cell, and each
setting's task gets them all, so a frame must be bounded: see `training.BOOST_ROWS`. Candidate thresholds follow Spark's
rule over all rows; Spark takes them from a sample of 10,000. 0/1 slots are categories, as their attributes say.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import write_stage

BINS = 32
#: Joint cells of columns that are counted together, at most.
CELLS = 4096
PURE = 2.0 ** -52

COLUMNS = "frame int, slot int, block long, cells binary, labels binary"
BINNED = "frame int, balanced boolean, slot int, cuts array<double>, cells binary, labels binary"
NODES = ("setting int, treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:long,"
         "gain:double,leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>")


@dataclass(frozen=True)
class Setting:
    """``frame``: position of the frame it learns from; weights of label 1 and 0 if balanced."""

    frame: int
    trees: int
    depth: int
    least: int
    rate: float
    weights: tuple[float, float] | None = None


def thresholds(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Spark's candidate thresholds: between all values if they are few, else nearest to equal shares of the weight."""
    distinct, at = np.unique(values, return_inverse=True)
    middle = (distinct[:-1] + distinct[1:]) / 2
    most = min(BINS, len(values)) - 1
    if len(middle) <= most:
        return middle
    share = np.bincount(at, weights)
    stride, sums = weights.sum() / (most + 1), np.cumsum(share)
    cuts, target = [], stride
    for before, now, cut in zip(sums[:-1].tolist(), sums[1:].tolist(), middle.tolist()):
        if abs(before - target) < abs(now - target):
            cuts.append(cut)
            target += stride
    return np.array(cuts)


def _packs(sizes: list[int], most: int) -> list[list[int]]:
    """Columns whose joint cells are counted in one go."""
    packs, cells = [[]], 1
    for j in sorted(range(len(sizes)), key=lambda j: sizes[j]):
        if packs[-1] and cells * sizes[j] > most:
            packs, cells = [*packs, []], 1
        packs[-1].append(j)
        cells *= sizes[j]
    return packs


class Boosting:
    """Trees of one setting over cells (columns by rows), grown one after the other."""

    def __init__(self, cells: np.ndarray, sizes: list[int], labels: np.ndarray, setting: Setting):
        self.by_row, self.sizes, self.setting = np.ascontiguousarray(cells.T).ravel(), sizes, setting
        self.target = 2.0 * labels - 1
        n = len(labels)
        self.w = None if setting.weights is None else np.where(labels == 1, *setting.weights)
        self.packs = _packs(sizes, int(np.clip(n // 64, BINS, CELLS)))
        self.codes = []
        for pack in self.packs:
            code = np.zeros(n, np.int32)
            for j in pack:
                code = code * sizes[j] + cells[j]
            self.codes.append(code)
        self.splits = np.arange(BINS - 1)[None, :] < np.array(sizes)[:, None] - 1

    def counted(self, rows, node: np.ndarray, k: int, g: np.ndarray, w: np.ndarray | None) -> np.ndarray:
        """Rows, weight and weighted sum of ``g`` by node, column and bin."""
        out = np.zeros((3, k, len(self.sizes), BINS))
        for pack, code in zip(self.packs, self.codes):
            dims = [self.sizes[j] for j in pack]
            size = int(np.prod(dims))
            at = node * size + (code if rows is None else code.take(rows))
            for i, weights in enumerate((None, w, g)):
                if i == 1 and w is None:
                    continue
                joint = np.bincount(at, weights, k * size).reshape(k, *dims)
                for axis, j in enumerate(pack):
                    out[i, :, j, :self.sizes[j]] = joint.sum(axis=tuple(a + 1 for a in range(len(pack)) if a != axis))
        if w is None:
            out[1] = out[0]
        return out

    def best(self, table: np.ndarray):
        """Gain, column and bin of the best split of each node."""
        left = np.cumsum(table, axis=3)
        total = left[:, :, :, -1:]
        left = left[:, :, :, :-1]
        right = total - left
        allowed = (left[0] >= self.setting.least) & (right[0] >= self.setting.least) & self.splits
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (left[2] ** 2 / left[1] + right[2] ** 2 / right[1] - total[2] ** 2 / total[1]) / total[1]
        gain = np.where(allowed, gain, -np.inf).reshape(len(gain), -1)
        at = (gain >= gain.max(axis=1, keepdims=True) * (1 - 1e-12)).argmax(axis=1)     # the first of those that rounding alone tells apart
        return gain[np.arange(len(at)), at], at // (BINS - 1), at % (BINS - 1), left.reshape(3, len(at), -1)[:, np.arange(len(at)), at]

    def grow(self, y: np.ndarray) -> tuple[list[list], np.ndarray]:
        """Nodes [rows, weight, sum, squares, gain, column, bin, low first, left, right] and the node that each row ends in."""
        wy = y if self.w is None else y * self.w
        wyy = wy * y
        ends = np.zeros(len(y), np.int64)
        rows, node, numbers = None, np.zeros(len(y), np.int64), [0]
        nodes: list[list] = []
        table = None
        for level in range(self.setting.depth + 1):
            k = len(numbers)
            pick = lambda a: a if rows is None else a.take(rows)
            raw = np.bincount(node, minlength=k)
            sums, squares = np.bincount(node, pick(wy), k), np.bincount(node, pick(wyy), k)
            weight = raw.astype(float) if self.w is None else np.bincount(node, pick(self.w), k)
            nodes += [[int(a), float(b), float(c), float(d), -1.0, -1, -1, True, -1, -1] for a, b, c, d in zip(raw, weight, sums, squares)]
            if level == self.setting.depth:
                break
            if level == 0:
                table = self.counted(None, node, 1, wy, self.w)
            else:       # the smaller child is counted, the other is what its parent has besides
                small = np.array([min(2 * p, 2 * p + 1, key=lambda c: raw[c]) for p in range(k // 2)])
                place = np.full(k, -1)
                place[small] = np.arange(k // 2)
                at = place.take(node)
                some = np.flatnonzero(at >= 0)
                chosen = rows.take(some)
                own = self.counted(chosen, at.take(some), k // 2, wy.take(chosen), None if self.w is None else self.w.take(chosen))
                both = np.zeros((3, k, *own.shape[2:]))
                both[:, small], both[:, small ^ 1] = own, table - own
                table = both
            gain, column, cut, left = self.best(table)
            impurity = (squares - sums ** 2 / weight) / weight
            split = (gain > 0) & ((np.abs(impurity) >= PURE) | (level == 0))
            first = len(nodes)
            children = []
            for i in np.flatnonzero(split).tolist():
                own = nodes[numbers[i]]
                mean_left = left[2, i] / left[1, i]
                mean_right = (sums[i] - left[2, i]) / (weight[i] - left[1, i])
                own[4:] = [float(gain[i]), int(column[i]), int(cut[i]), bool(mean_left <= mean_right), first + len(children), first + len(children) + 1]
                children += own[8:]
            number = np.array(numbers)
            rows, at = np.arange(len(y)) if rows is None else rows, node
            if not split.all():
                going = split.take(node)
                stay, go = np.flatnonzero(~going), np.flatnonzero(going)
                ends[rows.take(stay)] = number.take(node.take(stay))
                rows, at = rows.take(go), node.take(go)
            if not children:
                break
            order = 2 * (np.cumsum(split) - 1)
            node = order.take(at) + (self.by_row.take(rows * len(self.sizes) + column.take(at)) > cut.take(at))
            table, numbers = table[:, split], children
        if rows is None:
            rows = np.arange(len(y))
        if len(rows):
            ends[rows] = np.array(numbers).take(node)
        return nodes, ends

    def trees(self):
        """Nodes of each tree, one after the other."""
        score, y = np.zeros(len(self.target)), self.target
        for t in range(self.setting.trees):
            nodes, ends = self.grow(y)
            yield nodes
            mean = np.array([n[2] / n[1] for n in nodes])
            score += (self.setting.rate if t else 1.0) * mean[ends]
            y = 4.0 * self.target / (1.0 + np.exp(2.0 * self.target * score))


def saved(nodes: list[list], cuts: list[np.ndarray], categories: set[int]) -> list[dict]:
    """The tree as rows of Spark's node table; equal leaves of one parent are one leaf, as in Spark."""
    out: list[dict] = []

    def row(i: int) -> dict:
        raw, weight, total, squares = nodes[i][:4]
        return {"prediction": total / weight, "impurity": (squares - total * total / weight) / weight, "impurityStats": [weight, total, squares],
                "rawCount": raw, "gain": -1.0, "leftChild": -1, "rightChild": -1, "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}}

    def put(i: int) -> bool:
        own = {"id": len(out)} | row(i)
        out.append(own)
        _, _, _, _, gain, column, cut, low, left, right = nodes[i]
        if left < 0:
            return True
        ordered = (left, right) if low or column not in categories else (right, left)
        own["leftChild"] = len(out)
        one = put(ordered[0])
        own["rightChild"] = len(out)
        other = put(ordered[1])
        if one and other and out[-1]["prediction"] == out[-2]["prediction"]:
            del out[-2:]
            own["leftChild"] = own["rightChild"] = -1
            return True
        own["gain"] = gain
        if column in categories:
            side = [0.0] if ordered[0] == left else [1.0]
            own["split"] = {"featureIndex": column, "leftCategoriesOrThreshold": side, "numCategories": 2}
        else:
            own["split"] = {"featureIndex": column, "leftCategoriesOrThreshold": [float(cuts[column][cut])], "numCategories": -1}
        return False

    put(0)
    return out


def categories(frame: DataFrame, features: str) -> set[int]:
    """Slots that Spark's trees take as 0/1 categories."""
    groups = frame.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    return {a["idx"] for a in groups.get("binary", [])}


def fit(frames: list[DataFrame], features: str, target: str, settings: list[Setting]) -> DataFrame:
    """Node tables of all settings, staged: `setting` is the position, the rest as Spark saves an ensemble."""
    kinds = [categories(f, features) for f in frames]

    def columns(frame: int):
        def turn(batches):
            from pyspark import TaskContext
            block = TaskContext.get().partitionId() << 32
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
                d = x.shape[1]
                yield pa.RecordBatch.from_arrays([
                    pa.array([frame] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([block] * d, pa.int64()),
                    pa.array([np.ascontiguousarray(x[:, j]).tobytes() for j in range(d)], pa.binary()),
                    pa.array([labels] * d, pa.binary())], names=["frame", "slot", "block", "cells", "labels"])
                block += 1
        return turn

    asked = sorted({(s.frame, s.weights) for s in settings}, key=repr)

    def binned(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        frame, slot = int(key[0]), int(key[1])
        rows = rows.sort_values("block")
        values, labels = np.frombuffer(b"".join(rows.cells)), np.frombuffer(b"".join(rows.labels), np.uint8)
        out = []
        for weights in (w for f, w in asked if f == frame):
            if slot in kinds[frame]:
                cuts, cells = np.zeros(1), values.astype(np.int64).clip(0, 1)
            else:
                cuts = thresholds(values, np.ones(len(values)) if weights is None else np.where(labels == 1, *weights))
                cells = np.searchsorted(cuts, values)
            out.append((frame, weights is not None, slot, cuts.tolist(), cells.astype(np.uint8).tobytes(), labels.tobytes() if slot == 0 else b""))
        return pd.DataFrame(out, columns=["frame", "balanced", "slot", "cuts", "cells", "labels"])

    parts = [f.select(vector_to_array(features).alias("x"), F.col(target).cast("int")).mapInArrow(columns(i), COLUMNS) for i, f in enumerate(frames)]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    table = write_stage(table.groupBy("frame", "slot").applyInPandas(binned, BINNED), "boost-columns")

    def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        setting, rows = settings[int(key[0])], rows.sort_values("slot")
        cuts = [np.asarray(c, dtype=float) for c in rows.cuts]
        labels = np.frombuffer(b"".join(rows.labels), np.uint8)
        cells = np.frombuffer(b"".join(rows.cells), np.uint8).reshape(len(rows), -1)
        trees = Boosting(cells, [len(c) + 1 for c in cuts], labels, setting).trees()
        out = [(int(key[0]), t, node) for t, nodes in enumerate(trees) for node in saved(nodes, cuts, kinds[setting.frame])]
        return pd.DataFrame(out, columns=["setting", "treeID", "nodeData"])

    each = table.sparkSession.createDataFrame(
        [(i, s.frame, s.weights is not None) for i, s in enumerate(settings)], "setting int, frame int, balanced boolean")
    dealt = table.join(F.broadcast(each), ["frame", "balanced"]).repartitionByRange(len(settings), "setting")    # one row a setting
    return write_stage(dealt.groupBy("setting").applyInPandas(learn, NODES), "boost-trees")
