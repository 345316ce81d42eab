"""Logistic regression by Newton steps, several settings in one pass over the rows.

Each task adds up, over its rows, the gradient and the Hessian of every setting;
Spark sums them, and what reaches the driver is a table of slots by settings,
whatever the number of rows. A fit takes a handful of passes and keeps no copy of
the rows in memory. Large frames start from the answer of a sample: that decides
how many passes follow, never the result, which is the minimum over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import write_stage

START_ROWS = 100_000        # sample that a large frame's fit starts from
MAX_PASSES = 100
#: A setting is done when the next step would lower its mean loss by less than this.
TOLERANCE = 1e-13


@dataclass
class Setting:
    """Minimise the weighted sum of log losses plus half of ``ridge`` times the squared coefficients.

    ``slots``: positions of the features used, all by default; the others have coefficient 0.
    """

    ridge: float
    positive: float = 1.0
    negative: float = 1.0
    slots: list[int] | None = None
    w: np.ndarray | None = None         # intercept first
    before: tuple = field(default=(None, np.inf), repr=False)
    done: bool = False


def _features(batch: pa.RecordBatch) -> np.ndarray:
    """All columns but the last, or the lists of the only one, as a matrix."""
    *columns, _ = batch.columns
    if pa.types.is_list(columns[0].type):
        return columns[0].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])


def _sums(factors: np.ndarray, settings: list[tuple]):
    """Task function: loss, gradient and upper half of the Hessian of each setting over the rows of a task.

    The target is the last column.
    """
    def add(batches):
        d = len(factors) + 1
        upper = np.triu_indices(d)
        totals = [[0.0, np.zeros(d), np.zeros((d, d))] for _ in settings]
        seen = False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            y = batch.columns[-1].to_numpy(zero_copy_only=False)
            x = np.column_stack([np.ones(len(y)), _features(batch) * factors])
            z = x @ np.column_stack([w for w, *_ in settings])
            p = 0.5 * (1 + np.tanh(0.5 * z))
            for j, (_, positive, negative) in enumerate(settings):
                weight = np.where(y == 1, positive, negative)
                total = totals[j]
                total[0] += float(weight @ np.logaddexp(0, np.where(y == 1, -z[:, j], z[:, j])))
                total[1] += x.T @ (weight * (p[:, j] - y))
                total[2] += x.T @ (x * (weight * p[:, j] * (1 - p[:, j]))[:, None])
        if seen:
            rows = np.array([np.concatenate([[loss], g, h[upper]]) for loss, g, h in totals])
            k, slots = rows.shape
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(k), slots), pa.int32()), pa.array(np.tile(np.arange(slots), k), pa.int32()),
                pa.array(rows.ravel(), pa.float64())], names=["setting", "slot", "value"])

    return add


def _descend(rows: DataFrame, n: int, factors: np.ndarray, settings: list[Setting]) -> None:
    """Newton steps of all settings side by side, halved where the loss has grown."""
    d = len(factors) + 1
    upper, ridge_slots = np.triu_indices(d), np.r_[0.0, np.ones(d - 1)]
    for s in settings:
        s.w, s.before, s.done = (np.zeros(d) if s.w is None else s.w), (None, np.inf), False
    for _ in range(MAX_PASSES):
        open_ones = [s for s in settings if not s.done]
        if not open_ones:
            return
        task = _sums(factors, [(s.w, s.positive, s.negative) for s in open_ones])
        sums = np.zeros((len(open_ones), 1 + d + len(upper[0])))
        # slots by settings: a table whose size the columns fix
        for r in (rows.mapInArrow(task, "setting int, slot int, value double")
                  .groupBy("setting", "slot").agg(F.sum("value").alias("value")).collect()):
            sums[r.setting, r.slot] = r.value
        for s, total in zip(open_ones, sums):
            loss = total[0] + s.ridge * (s.w[1:] @ s.w[1:]) / 2
            if loss > s.before[1] * (1 + 1e-12):
                s.w = (s.w + s.before[0]) / 2
                continue
            gradient = total[1:1 + d] + s.ridge * ridge_slots * s.w
            hessian = np.zeros((d, d))
            hessian[upper] = total[1 + d:]
            hessian = hessian + np.triu(hessian, 1).T + s.ridge * np.diag(ridge_slots)
            at = np.arange(d) if s.slots is None else np.r_[0, np.asarray(s.slots) + 1]
            slope, bend, step = gradient[at], hessian[np.ix_(at, at)], np.zeros(d)
            step[at] = np.linalg.lstsq(bend, slope, rcond=None)[0] if s.ridge <= 0 else np.linalg.solve(bend, slope)
            s.before, s.w = (s.w, loss), s.w - step
            s.done = bool(gradient @ step / 2 <= TOLERANCE * n)
    raise RuntimeError(f"no minimum in {MAX_PASSES} passes")


def fit(frame: DataFrame, features: str | list[str], target: str, key: str, factors, settings: list[Setting]) -> None:
    """Sets ``w`` of each setting; features, a vector column or numeric columns, are multiplied by ``factors``.

    Plain columns are much cheaper to read than vectors. Needs rows of both classes.
    """
    factors = np.asarray(factors, dtype=float)
    x = [vector_to_array(features).alias("x")] if isinstance(features, str) else [F.col(c) for c in features]
    columns = [*x, F.col(target).cast("double").alias("y")]
    rows = frame.select(*columns)
    n = frame.count()
    share = n // START_ROWS
    if share > 1:
        drawn = frame.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(share)) == 0)
        sample = write_stage(drawn.select(*columns), "newton-start")
        size, positives = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
        if 0 < positives < size:
            for s in settings:
                s.ridge /= share
            _descend(sample, size, factors, settings)
            for s in settings:
                s.ridge *= share
    _descend(rows, n, factors, settings)
