"""The range finder and PCA completion against a dense SVD."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from settlegrid.operators import latent as L
from settlegrid.operators.subspace import leading_directions, triangle


def long(spark, m, first=0):
    rows = [(first + i, j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "id int, pos int, value double")


def dense(components):
    return np.array([r["c"] for r in components.orderBy("pos").collect()])


def test_triangle_of_a_table_over_many_tasks(spark):
    m = np.random.default_rng(1).normal(size=(300, 5))
    thin = spark.createDataFrame([(r.tolist(),) for r in m], "v array<double>").repartition(7)
    r = triangle(thin, "v")
    assert r.shape == (5, 5) and np.allclose(r.T @ r, m.T @ m)


@pytest.mark.parametrize("shape, k, oversample", [((40, 90), 4, 4), ((60, 12), 3, 10)])
def test_directions_equal_a_dense_svd(spark, shape, k, oversample):
    m = np.random.default_rng(2).normal(size=shape) * 0.9 ** np.arange(shape[1])
    found, size = leading_directions(long(spark, m), k, oversample)
    _, s, vt = np.linalg.svd(m, full_matrices=False)
    c = dense(found)
    assert np.allclose(size, s[:k], rtol=1e-7)
    assert np.linalg.svd(c.T @ vt[:k].T)[1].min() > 1 - 1e-6  # cosines of the angles between both spaces
    assert np.allclose(c.T @ c, np.eye(k), atol=1e-9) and (c[np.abs(c).argmax(0), range(k)] > 0).all()


def test_lower_rank_gives_fewer_directions(spark):
    m = np.outer(np.arange(1, 7), [1.0, 2, 0, -1])
    found, size = leading_directions(long(spark, m), 3)
    assert len(size) == 1 and np.allclose(np.abs(dense(found)[:, 0]), np.abs([1, 2, 0, -1]) / 6 ** 0.5)


def test_completion_on_three_axes_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 4)) @ rng.normal(size=(4, 16)) + 0.05 * rng.normal(size=(30, 16))
    fit = L.completion(long(spark, x[:24]), long(spark, x[24:], 24), F.col("pos") < 11, k=3)
    mean, sd = x[:24].mean(0), x[:24].std(0)
    v = np.linalg.svd((x[:24] - mean) / sd, full_matrices=False)[2][:3]
    t = (x[24:] - mean) / sd
    z = np.linalg.lstsq(v[:, :11].T, t[:, :11].T, rcond=None)[0].T
    got = {(r["id"], r["pos"]): r["value"] for r in fit["prediction"].collect()}
    assert np.allclose([got[24 + i, j] for i in range(6) for j in range(16)], (z @ v).ravel(), atol=1e-6)
    scores = L.completion_scores(fit["train"], fit["reconstruction"], fit["test"], fit["prediction"], fit["scale"], F.col("pos") >= 11).first()
    error = (z @ v - t)[:, 11:]
    assert np.isclose(scores["withheld_mse_standardised"], (error ** 2).mean(), rtol=1e-6)
    assert np.isclose(scores["withheld_rmse_source_units"], np.sqrt(((error * sd[11:]) ** 2).mean()), rtol=1e-6)


def test_open_directions_take_the_smallest_solution(spark):
    comps = spark.createDataFrame([(0, 1.0, 0.0), (1, 0.0, 1.0)], "pos int, c1 double, c2 double")
    z = L.coordinates(long(spark, [[2.0, 5.0]]), comps, F.col("pos") == 0).first()
    assert (z["z1"], z["z2"]) == (2.0, 0.0)
