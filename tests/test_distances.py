import numpy as np
import pytest

from formlens.operators import inverse, overlap, transforms


def cohort(spark, *arrays):
    rows = [(m, int(x), int(y), int(z)) for m, a in enumerate(arrays) for x, y, z in np.argwhere(a)]
    return spark.createDataFrame([(m,) for m in range(len(arrays))], "mask_id long"), spark.createDataFrame(rows, "mask_id long, x int, y int, z int")


def test_envelope_as_all_pairs():
    rng = np.random.default_rng(0)
    for n in (1, 2, 17, 40):
        f = np.where(rng.random((n, 300)) < 0.5, rng.integers(0, 1 + n * n, (n, 300)), transforms.FAR)
        f[:, 0] = transforms.FAR
        f[:, 1] = np.arange(n)[::-1] ** 2  # each new parabola pops the last
        at = np.arange(n)
        want = np.minimum((f[None] + ((at[:, None] - at[None]) ** 2)[:, :, None]).min(1), transforms.FAR)
        assert (transforms.envelope(f) == want).all()


@pytest.mark.parametrize("cells", [1, 100, 1 << 18])
def test_fields_in_blocks_as_dense(spark, cells):
    rng = np.random.default_rng(1)
    shape = (7, 9, 6)
    one = np.zeros(shape, bool)
    one[6, 8, 0] = True
    arrays = [rng.random(shape) < 0.3, one, np.zeros(shape, bool), np.ones(shape, bool), ~one]
    meta, voxel = cohort(spark, *arrays)
    got = transforms.distance_fields(meta, voxel, shape, cells).toPandas()
    for m, a in enumerate(arrays):
        part = got[got.mask_id == m]
        d = np.zeros(shape, np.int64)
        d[part.x, part.y, part.z] = part.d2
        assert len(part) == a.size and (d == transforms.signed_squares(a)).all()
    features = {r.mask_id: r.features for r in transforms.dct_features(meta, voxel, shape, 4, cells=cells).collect()}
    assert features[2] is None and features[3] is None
    for m in (0, 1, 4):
        np.testing.assert_allclose(features[m], transforms.dct_of(arrays[m], 4, True, 5.0), atol=1e-9)


def test_nearest_in_blocks_as_all_pairs():
    rng = np.random.default_rng(2)
    for n, m, scale in ((1, 1, 5), (700, 3, 50), (3000, 5000, 40), (900, 900, 2)):
        a, b = rng.integers(0, scale, (n, 3)).astype(float), rng.integers(0, scale, (m, 3)).astype(float) + [0, scale // 2, 0]
        blocks = overlap.point_blocks(a, 64)
        assert sorted(map(tuple, np.concatenate([x[0] for x in blocks]))) == sorted(map(tuple, a)) and max(len(x[0]) for x in blocks) <= 64
        got = overlap.nearest_squares(blocks, overlap.point_blocks(b, 64))
        own = np.concatenate([x[0] for x in blocks])
        want = np.concatenate([((own[k : k + 100, None] - b[None]) ** 2).sum(2).min(1) for k in range(0, n, 100)])
        assert (got == want).all()


def test_far_blocks_are_left_out():
    """Two long sheets: each block of one meets a few blocks of the other, not all."""
    g = np.stack(np.meshgrid(np.arange(400.0), np.arange(40.0), [0.0], indexing="ij"), -1).reshape(-1, 3)
    a, b = overlap.point_blocks(g, 256), overlap.point_blocks(g + [0.0, 0.0, 3.0], 256)
    met = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            met.append(1)
            return np.asarray(self) @ np.asarray(other)

    got = overlap.nearest_squares([x._replace(left=x.left.view(Counted)) for x in a], b)
    assert (got == 9).all() and len(met) < 6 * len(a) < len(a) * len(b) / 8


def ball(n, radius):
    return ((np.indices((n,) * 3) - (n - 1) / 2) ** 2).sum(0) <= radius**2


@pytest.mark.parametrize(("cheby", "whole"), [(True, False), (False, False), (False, True)])
def test_fits_by_sums_as_dense(spark, cheby, whole):
    rng = np.random.default_rng(4)
    shape = (9, 9, 9)
    arrays = [ball(9, 3), rng.random(shape) < 0.5, np.zeros(shape, bool)]
    meta, voxel = cohort(spark, *arrays)
    got = {r.mask_id: r for r in transforms.polynomial_features(meta, voxel, shape, 3, cheby, 1e-2, whole).collect()}
    assert set(got) == {0, 1}
    for m, r in got.items():
        c, centre, scale = transforms.polynomial_fit(arrays[m], 3, cheby, 1e-2, whole=whole)
        np.testing.assert_allclose(r.features, c, atol=1e-8)
        assert r.scale == scale and r.centre == list(centre)
    parts = transforms.normal_sums(transforms.distance_fields(transforms.frames_of(meta, voxel, shape, cheby), voxel, shape, 1, known=("centre", "scale")).repartition(5), 3, cheby, held=1)
    again = {r.mask_id: r.features for r in transforms.solved(parts, 3, cheby, 1e-2, whole).collect()}
    for m, r in got.items():
        np.testing.assert_allclose(again[m], r.features, atol=1e-8)


def test_fits_of_samples(spark):
    """A fit of seeded samples of the bands is near that of all cells, and gives much the same ball."""
    meta, voxel = cohort(spark, ball(20, 6))
    shape = (20,) * 3
    some = lambda field: inverse.band_samples(field, 2000, seed=1)
    fit = transforms.polynomial_features(meta, voxel, shape, 4, True, 1e-3, samples=some).first()
    centre, scale = np.array(fit.centre), fit.scale
    got = transforms.polynomial_mask(np.array(fit.features), shape, 4, True, centre, scale)
    want = ball(20, 6)
    assert 2 * (got & want).sum() / (got.sum() + want.sum()) > 0.93
