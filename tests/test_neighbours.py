"""Neighbour search and oversampling against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import balance, knn


def brute_mean(X, column, k):
    out = X[:, column].copy()
    donors = np.where(~np.isnan(X[:, column]))[0]
    for i in np.where(np.isnan(out))[0]:
        diff = (X[donors] - X[i]) ** 2
        shared = (~np.isnan(diff)).sum(1)
        dist = np.where(shared > 0, np.nansum(diff, axis=1) * X.shape[1] / np.maximum(shared, 1), np.inf)
        near = np.lexsort((X[donors, column], dist))
        near = near[np.isfinite(dist[near])][:k]
        out[i] = X[donors[near], column].mean() if len(near) else np.nan
    return out


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(knn, "CELL_DONORS", 40)
    monkeypatch.setattr(knn, "PART_DONORS", 16)
    monkeypatch.setattr(knn, "PART_QUERIES", 32)


def test_search_inside_a_task(monkeypatch):
    """Many leaves, ties and copies against all distances at once."""
    monkeypatch.setattr(knn, "LEAF_DONORS", 8)
    monkeypatch.setattr(knn, "GAP_CELLS", 50)
    rng = np.random.default_rng(2)
    donors = np.unique(rng.integers(0, 12, (400, 3)), axis=0).astype(float)
    values = rng.integers(0, 5, len(donors)).astype(float)
    points = rng.integers(-3, 15, (150, 3)).astype(float)
    row, dist, value, donor = knn._local(points, donors, values, 4, 1.5)
    D = ((points[:, None] - donors[None]) ** 2).sum(-1) * 1.5
    for i in range(len(points)):
        best = np.lexsort((values, D[i]))[:4]
        assert dist[row == i].tolist() == D[i, best].tolist()
        assert value[row == i].tolist() == values[best].tolist()


def test_a_query_meets_few_boxes(monkeypatch):
    """Work per query does not grow with the number of leaves or cells."""
    monkeypatch.setattr(knn, "LEAF_DONORS", 8)
    met, gaps = [], knn._gaps
    monkeypatch.setattr(knn, "_gaps", lambda p, low, high: met.append(len(p) * len(low)) or gaps(p, low, high))
    rng = np.random.default_rng(4)
    donors, points = rng.random((2, 4096, 2)) * 1e6
    row, dist, _, _ = knn._local(points, donors, np.zeros(4096), 3, 1.0)
    D = np.sort(((points[:200, None] - donors[None]) ** 2).sum(-1), axis=1)[:, :3]
    assert dist[row < 200].reshape(200, 3) == pytest.approx(D, rel=1e-12)
    assert sum(met) < 4096 * 512 / 5


def test_query_of_a_cell_without_donors(spark, small_cells):
    """Most donors are equal, so a cut leaves a cell empty; its queries look elsewhere, within a distance."""
    vecs = [[5.0, 5.0]] * 3 + [[5.0, 9.0], [5.0, 40.0]]
    donors = spark.createDataFrame([(0, v, float(i), 30) for i, v in enumerate(vecs)],
                                   "cls int, vec array<double>, value double, n long")
    trees = {0: (np.array([0, 0, 0]), np.array([5.0, 5.0, 7.0]))}
    monkey = pytest.MonkeyPatch()
    monkey.setattr(knn, "_fit_cells", lambda _: trees)
    queries = spark.createDataFrame([(1, 0, [6.0, 5.0]), (2, 0, [90.0, 41.0])], "qid long, cls int, vec array<double>")
    found = {r.qid: [(c.d, c.value) for c in r.found] for r in knn.nearest(queries, donors, 20, {0: 1.0}).collect()}
    monkey.undo()
    assert found == {1: [(1.0, 0.0)], 2: [(85.0 ** 2 + 1, 4.0)]}


@pytest.mark.parametrize("copies", [0.0, 0.4])
def test_knn_mean_equals_brute_force(spark, small_cells, copies):
    """Many cells and parts; in the second case 40 % of the rows are copies."""
    rng = np.random.default_rng(11)
    n = 700
    X = np.column_stack([rng.integers(0, 900, n), rng.integers(0, 50, n), rng.integers(0, 400, n),
                         rng.integers(0, 9, n)]).astype(float)
    same = rng.random(n) < copies
    X[same] = [100.0, 7.0, 50.0, 3.0]
    X[rng.random(n) < .2, 0] = np.nan
    X[rng.random(n) < .3, 1] = np.nan
    frame = pd.DataFrame(X, columns=list("abcd"))
    frame.insert(0, "id_solicitud", np.arange(n))
    df = spark.createDataFrame(frame).select("id_solicitud", *[F.nanvl(c, F.lit(None)).alias(c) for c in "abcd"])
    got = knn.knn_mean(df, df, list("abcd"), ["a", "b"], 5).toPandas().set_index("id_solicitud")
    for j, c in enumerate("ab"):
        expected = brute_mean(X, j, 5)
        missing = np.where(np.isnan(X[:, j]))[0]
        assert got.loc[missing, f"knn_{c}"].to_numpy() == pytest.approx(expected[missing], rel=1e-12)


def test_cells_stay_balanced_when_values_repeat():
    points = np.column_stack([np.where(np.arange(640) % 10 < 6, 100.0, 0.0), np.arange(640) % 64])
    leaves = knn._descend(knn._grow(points, 4), points)
    assert np.bincount(leaves, minlength=16).max() <= 80


def test_fewer_donors_than_neighbours(spark):
    df = spark.createDataFrame([(1, None, 0.0), (2, 4.0, 1.0), (3, 8.0, 9.0)], "id_solicitud long, a double, b double")
    assert knn.knn_mean(df, df, ["a", "b"], ["a"], 10).first().knn_a == 6.0


def frame_of(spark, minority, majority, width=3, seed=5):
    rng = np.random.default_rng(seed)
    X = rng.integers(0, 30, (minority + majority, width)).astype(float)
    X[: minority // 3] = X[0]                       # a third of the minority are copies
    rows = [(i, int(i < minority), x.tolist()) for i, x in enumerate(X)]
    df = spark.createDataFrame(rows, "id_solicitud long, default_12m int, v array<double>")
    return df.select("id_solicitud", "default_12m", array_to_vector("v").alias("features")), X[:minority]


def test_smote_counts(spark):
    df, _ = frame_of(spark, 10, 100)
    out = balance.smote(df, 0.3)
    assert out.where("id_solicitud < 0").count() == 20
    assert out.where("default_12m = 0").count() == 100
    assert balance.smote(df, None).count() == 110
    with pytest.raises(ValueError):
        balance.smote(df, 0.05)


def test_smote_rows_lie_between_neighbours(spark, small_cells):
    df, M = frame_of(spark, 90, 400)
    out = balance.smote(df, 0.8).where("id_solicitud < 0").select(
        "id_solicitud", vector_to_array("features").alias("v")).toPandas()
    D = ((M[:, None] - M[None]) ** 2).sum(-1)
    np.fill_diagonal(D, np.inf)
    kth = np.sort(D, axis=1)[:, 4]
    i, j = np.nonzero(D <= kth[:, None])
    A, B = M[i], M[j] - M[i]
    length = (B ** 2).sum(1)
    for z in np.stack(out.v):
        t = np.clip(((z - A) * B).sum(1) / np.where(length > 0, length, 1), 0, 1)
        assert ((A + t[:, None] * B - z) ** 2).sum(1).min() < 1e-12


def test_smote_does_not_depend_on_partitions(spark):
    df, _ = frame_of(spark, 30, 100)
    def synthetic(frame):
        rows = balance.smote(frame, 0.6).where("id_solicitud < 0").select(
            "id_solicitud", vector_to_array("features").alias("v")).collect()
        return sorted((r.id_solicitud, tuple(r.v)) for r in rows)
    assert synthetic(df) == synthetic(df.repartition(7))


def test_donors_are_written_once(spark, small_cells, monkeypatch):
    """Told how many rows they come from, donors get their cells before they are written, with the same answer."""
    rng = np.random.default_rng(6)
    rows = [(0, [float(a), float(b)], float(v)) for a, b, v in rng.integers(0, 20, (600, 3))]
    pool = spark.createDataFrame(rows, "cls int, vec array<double>, value double")
    donors = pool.groupBy("cls", "vec", "value").agg(F.count("*").alias("n"))
    queries = spark.createDataFrame([(i, 0, [float(a), float(b)]) for i, (a, b) in enumerate(rng.integers(0, 20, (80, 2)))],
                                    "qid long, cls int, vec array<double>")
    written, write = [], knn.write_stage
    monkeypatch.setattr(knn, "write_stage", lambda df, name: written.append(name) or write(df, name))
    twice = {r.qid: r.found for r in knn.nearest(queries, donors, 5, {0: 1.5}).collect()}
    assert written[:2] == ["knn-donors", "knn-cells"]
    written.clear()
    assert {r.qid: r.found for r in knn.nearest(queries, donors, 5, {0: 1.5}, rows={0: 600}).collect()} == twice
    assert "knn-donors" not in written and len(twice) == 80
