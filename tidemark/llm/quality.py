"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled
text. A text is compressed whole with each; the difference of the two sizes over
their sum says which class it resembles. A logistic curve fitted on labelled rows
outside the dictionaries turns it into a score. The curve also sees how far the
text compresses at all, with its length: a text that only repeats itself is small
with either dictionary, so its difference says nothing.

Learning takes a bounded sample of labelled rows: ``per_class`` rows a class for
the dictionaries and ``calibration`` rows for the curve, the rows whose hashed id
is least; rows over ``max_chars`` are left out of the sample (never of scoring).

Defined cases: a null text counts as empty; empty texts compress equally with
both and all get one score; ids whose labels contradict each
other and null labels teach nothing; repeated rows count once each; without
labels of both classes every score is the share of label 1 (0.5 without labels);
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL = 3


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: list[float]        # of the difference, the compression, the length and the constant; empty: nothing learned
    prior: float


def _sizes(model_good: bytes, model_bad: bytes):
    def ready(data: bytes):
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)
    return ready(model_good), ready(model_bad)


def measures(texts, good: bytes, bad: bytes) -> np.ndarray:
    """Per text: (bad size - good size) / (their sum), log of the compression by the better one, log of the length."""
    as_good, as_bad = _sizes(good, bad)
    out = np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        data = text.encode() if text else b""
        g, b = len(as_good.compress(data)), len(as_bad.compress(data))
        out[i] = (b - g) / (b + g), np.log((min(g, b) + 1) / (len(data) + 1)), np.log(len(data) + 1)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Weights of the columns of ``x`` and the constant, by Newton steps on scaled columns."""
    middle, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    z = np.column_stack([(x - middle) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, z.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return [*(w[:-1] / scale), float(w[-1] - (w[:-1] * middle / scale).sum())]


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, per_class: int = 2000, calibration: int = 6000,
        dictionary_bytes: int = 112_640, max_chars: int = 200_000) -> QualityModel:
    """Learns from rows of ``labels`` (doc_id, quality) for which ``learnable`` holds."""
    known = (labels.where(learnable & F.col("quality").isin(0, 1)).groupBy("doc_id")
             .agg(F.min("quality").alias("quality"), F.max("quality").alias("top")).where("quality = top").drop("top")
             .withColumn("h", F.xxhash64(F.lit("quality"), "doc_id")))
    picks = [known.where(F.col("quality") == q).orderBy("h", "doc_id").limit(per_class).withColumn("use", F.lit("dictionary"))
             for q in (0, 1)]
    picks.append(known.orderBy(F.col("h").desc(), "doc_id").limit(calibration).withColumn("use", F.lit("curve")))
    chosen = picks[0].unionByName(picks[1]).unionByName(picks[2])
    rows = (docs.where(F.length("text").between(1, max_chars)).select("doc_id", "text")
            .join(F.broadcast(chosen.drop("h")), "doc_id").toPandas())     # at most 2 per_class + calibration ids
    book = rows[rows.use == "dictionary"].drop_duplicates("doc_id").sort_values("doc_id")
    samples = {q: [t.encode() for t in book.text[book.quality == q]] for q in (0, 1)}
    curve = rows[(rows.use == "curve") & ~rows.doc_id.isin(book.doc_id)].drop_duplicates("doc_id").sort_values("doc_id")
    if len(curve) < 50 or curve.quality.nunique() < 2:
        curve = rows.drop_duplicates("doc_id").sort_values("doc_id")
    if not samples[0] or not samples[1]:
        share = float(rows.quality.mean()) if len(rows) else 0.5
        return QualityModel(b"", b"", [], share)
    good, bad = (_dictionary(samples[q], dictionary_bytes) for q in (1, 0))
    weights = _logistic(measures(curve.text.tolist(), good, bad), curve.quality.to_numpy(float))
    return QualityModel(good, bad, weights, float(curve.quality.mean()))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples themselves where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def score(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted."""
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if not model.weights:
            return pd.Series(np.full(len(texts), model.prior))
        z = measures(texts.tolist(), model.good, model.bad) @ model.weights[:-1] + model.weights[-1]
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return docs.withColumn("score", scored(text)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
