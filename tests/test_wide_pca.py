import numpy as np
import pytest

from formlens.operators import cohort_model, wide_pca


def features(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "mask_id long, features array<double>")


def dense(x):
    c = x - x.mean(0)
    _, s, v = np.linalg.svd(c, full_matrices=False)
    return s**2 / max(1, len(x) - 1), cohort_model._signed(v)


@pytest.mark.parametrize(("n", "f", "rows", "width"), [(30, 200, 7, 64), (150, 12, 2, 12)])
def test_as_dense(spark, n, f, rows, width):
    """Large means, more blocks than are added at once, more features than masks and fewer."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 5)) * [9, 7, 5, 3, 2] @ rng.normal(size=(5, f)) + rng.normal(size=(n, f)) + 1e4
    df = features(spark, x)
    got = wide_pca.fit(df, 4, rows=rows, width=width)
    variance, vectors = dense(x)
    np.testing.assert_allclose(got.variance, variance[:4], rtol=1e-8)
    np.testing.assert_allclose(got.ratio, variance[:4] / variance.sum(), rtol=1e-8)
    assert got.residual.max() < 1e-6
    table = got.table().toPandas().sort_values("k")
    np.testing.assert_allclose(np.stack(table.component), vectors[:4], atol=1e-5)
    np.testing.assert_allclose(got.mean().toPandas().sort_values("i")["mean"], x.mean(0), rtol=1e-12)
    c = wide_pca.scores(df, got, rows=rows).toPandas().sort_values("mask_id")
    np.testing.assert_allclose(np.stack(c.coeffs), (x - x.mean(0)) @ vectors[:4].T / np.sqrt(variance[:4]), atol=1e-4)


def test_edges(spark):
    same = wide_pca.fit(features(spark, np.ones((5, 3))), 2)
    assert (same.variance == 0).all() and not np.isnan(same.ratio).any()
    one = wide_pca.fit(features(spark, [[1.0, 2.0]]), 2)
    assert len(one.variance) == 1 and one.variance[0] == 0
    two = wide_pca.fit(features(spark, [[0.0, 0.0], [3.0, 4.0]]), 5)
    np.testing.assert_allclose(two.variance, [12.5])
    nothing = features(spark, np.zeros((1, 2))).limit(0)
    assert wide_pca.scores(nothing, two).count() == 0
    with pytest.raises(ValueError, match="of one length"):
        wide_pca.fit(nothing, 2)
    with pytest.raises(ValueError, match="of one length"):
        wide_pca.fit(features(spark, [[1.0], [1.0, 2.0]]), 2)


def test_fit_goes_over_to_tiles(spark, monkeypatch):
    monkeypatch.setattr(cohort_model, "MOST", 8)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 12)) * np.arange(1, 13)
    got = cohort_model.fit(features(spark, x), 3)
    variance, vectors = dense(x)
    np.testing.assert_allclose(got.variance, variance[:3], rtol=1e-8)
    np.testing.assert_allclose(got.components, vectors[:3], atol=1e-5)
