"""Vector anomalies against plain numpy over all pairs."""

import numpy as np
import pytest

from orderloom.operators import vectors as V

SCHEMA = "vec_id bigint, embedding array<double>, distance string"


def brute(x, k=5):
    centred = x - x.mean(0)
    inverse = np.linalg.inv(np.cov(x, rowvar=False) + 1e-6 * np.eye(x.shape[1]))
    far = np.sqrt(np.einsum("ij,jk,ik->i", centred, inverse, centred))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.sort(d, 1)[:, min(k, len(x) - 1) - 1]
    return far, far > far.mean() + 3 * far.std(), near, near > np.quantile(near, 0.99)


@pytest.mark.parametrize("block,n", [(4096, 300), (40, 300), (7, 90)])
def test_against_all_pairs(spark, monkeypatch, block, n):
    monkeypatch.setattr(V, "BLOCK_ROWS", block)
    rnd = np.random.default_rng(n + block)
    x = rnd.normal(0, 1, (n, 6)) @ rnd.normal(0, 1, (6, 6)) + 5
    x[: n // 3] = x[0]  # a third are copies: distance 0, one radius
    x[-2:] *= 4
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)] + [(9000, None, ""), (9001, [], ""), (9002, [1.0] * 5, ""), (9003, [float("nan")] * 6, ""), (9004, [None] * 6, "")]
    got = V.vector_anomaly(spark.createDataFrame(rows, SCHEMA).repartition(4)).orderBy("vec_id").collect()
    far, odd, near, apart = brute(x)
    assert [r.vec_id for r in got] == list(range(n))
    assert np.allclose([r.distance for r in got], far, atol=1e-8) and [r.anomaly for r in got] == odd.tolist()
    assert np.allclose([r.knn_distance for r in got], near, atol=1e-9) and [r.knn_anomaly for r in got] == apart.tolist()
    assert [r.knn_distance for r in got][: n // 3] == [0.0] * (n // 3)


def test_the_shuffle_of_all_pairs_grows_with_the_rows(spark, monkeypatch):
    """Blocks are a share of the rows: four times the rows meet in as many pairs of blocks, and each row goes into as many of them."""
    monkeypatch.setattr(V, "BLOCK_ROWS", 16)
    monkeypatch.setattr(V, "BLOCKS", 4)
    monkeypatch.setattr(V, "TILE", (7, 9))
    met, staged = [], V.staged
    monkeypatch.setattr(V, "staged", lambda df, name: met.append(out := staged(df, name)) or out if name == "vector-meets" else staged(df, name))
    for n in (80, 320):
        x = np.random.default_rng(n).normal(0, 1, (n, 20))
        rows = spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, distance string")
        got = V.vector_anomaly(rows).orderBy("vec_id").collect()
        assert np.allclose([r.knn_distance for r in got], brute(x.astype(np.float32).astype(float))[2], atol=1e-9)
    few, many = (df.count() for df in met)
    assert 0 < many <= 2 * few


@pytest.mark.parametrize("few", [0, 16])
def test_closest_rows_tile_by_tile(monkeypatch, few):
    monkeypatch.setattr(V, "TILE", (5, 7))
    monkeypatch.setattr(V, "FEW", few)
    rnd = np.random.default_rng(few)
    a, b = rnd.normal(0, 1, (23, 4)), rnd.normal(0, 1, (31, 4))
    b[:9] = a[3]
    every = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    bound = np.maximum(np.sort(every, 1)[:, 2] - 1e-9, 0)
    want = np.where((near := np.sort(every, 1)[:, :5]) < bound[:, None], near, np.inf)
    assert np.allclose(V.closest(a, b, 5, bound), want, atol=1e-12)
    own = np.sqrt(((b[:, None] - b[None]) ** 2).sum(-1))
    np.fill_diagonal(own, np.inf)
    assert np.allclose(V.closest(b, b, 5, np.full(len(b), np.inf), same=True), np.sort(own, 1)[:, :5], atol=1e-12)


def test_small_tables(spark):
    assert V.vector_anomaly(spark.createDataFrame([], SCHEMA)).collect() == []
    (one,) = V.vector_anomaly(spark.createDataFrame([(1, [1.0, 2.0], "")], SCHEMA)).collect()
    assert (one.vec_id, one.distance, one.anomaly, one.knn_distance, one.knn_anomaly) == (1, 0.0, False, None, False)
    two = V.vector_anomaly(spark.createDataFrame([(1, [0.0, 0.0], ""), (1, [3.0, 4.0], "")], SCHEMA)).collect()
    assert [r.knn_distance for r in two] == [5.0, 5.0]
