import numpy as np
import pytest

from formlens.operators import masks, moments, resample


def voxels(spark, *arrays):
    rows = [(m, int(x), int(y), int(z)) for m, a in enumerate(arrays) for x, y, z in np.argwhere(a)]
    return spark.createDataFrame(rows, "mask_id long, x int, y int, z int")


def pear(n=20):
    g = np.indices((n,) * 3).reshape(3, -1).T - [9, 10, 8]
    inside = ((g / [4, 5, 7]) ** 2).sum(1) <= 1
    inside |= ((g - [3, 1, 1]) ** 2).sum(1) <= 9
    return inside.reshape((n,) * 3)


def trilinear(mask, frame, size, spacing):
    """Every new cell from all old voxels near it."""
    out = np.zeros((size,) * 3)
    pad = np.pad(mask.astype(float), 2)
    for o in np.ndindex(out.shape):
        w = np.asarray(frame["axes"]).T @ ((np.array(o) - (size - 1) / 2) * spacing / frame["scale"]) + frame["centre"]
        at = w / frame["spacing"]
        if (at < -1).any() or (at > np.array(mask.shape)).any():
            continue
        b = np.floor(at).astype(int)
        f = at - b
        out[o] = sum(np.where(c, f, 1 - f).prod() * pad[tuple(b + c + 2)] for c in np.ndindex(2, 2, 2))
    return out


@pytest.mark.parametrize("cube", [5, 32])
def test_trilinear_as_dense(spark, cube):
    q = np.linalg.qr(np.random.default_rng(2).normal(size=(3, 3)))[0]
    frame = {"spacing": [1.0, 1.5, 0.8], "centre": [9.0, 15.0, 6.5], "axes": q.tolist(), "scale": 0.7}
    mask = pear()
    frames = spark.createDataFrame([(0, *frame.values())], "mask_id long, spacing array<double>, centre array<double>, axes array<array<double>>, scale double")
    got = resample.resampled(voxels(spark, mask), frames, 17, 0.9, 0.25, cube).toPandas()
    dense = np.zeros((17,) * 3)
    dense[got.x, got.y, got.z] = got.value
    want = trilinear(mask, frame, 17, 0.9)
    np.testing.assert_allclose(dense, np.where(want > 0.25 + 1e-9, want, 0), atol=1e-12)
    assert len(got) == len(got.drop_duplicates(["x", "y", "z"])) > 100


def test_frames_as_points(spark):
    """With voxel sizes the frame is that of the voxels' places in the world; small masks have none."""
    mask, tiny = pear(), np.zeros((20,) * 3, bool)
    tiny[0, 0, :2] = True
    meta = spark.createDataFrame([(0, 1.0, 1.5, 0.8), (1, 1.0, 1.0, 1.0), (2, 1.0, 1.0, 1.0)], "mask_id long, dx double, dy double, dz double")
    got = resample.canonical_frames(voxels(spark, mask, tiny), meta).collect()
    centre, axes = moments.canonical_frame(np.argwhere(mask) * [1.0, 1.5, 0.8])
    assert [r.mask_id for r in got] == [0]
    np.testing.assert_allclose(got[0].centre, centre)
    np.testing.assert_allclose(np.array(got[0].axes).T, axes, atol=1e-9)


def test_normalised_forgets_voxel_sizes(spark):
    """The same shape in fine and in coarse, unequal voxels comes out alike, with the volume asked for."""
    g = np.indices((40,) * 3).reshape(3, -1).T
    of = lambda d: ((((g + 0.0) * d - [16, 15, 14]) / [7, 5, 11]) ** 2).sum(1) <= 1
    bump = lambda d: (((g * d - [21, 15, 14]) ** 2).sum(1) <= 16)
    sizes = [(0.8, 0.8, 0.8), (1.0, 0.8, 1.3)]
    arrays = [(of(d) | bump(d)).reshape((40,) * 3) for d in sizes]
    meta = spark.createDataFrame([(i, *d) for i, d in enumerate(sizes)], "mask_id long, dx double, dy double, dz double")
    got = resample.normalised(voxels(spark, *arrays), meta, 31, 2000.0, cube=8).toPandas()
    a, b = (set(map(tuple, got[got.mask_id == m][["x", "y", "z"]].to_numpy())) for m in (0, 1))
    assert abs(len(a) / 2000 - 1) < 0.03 and abs(len(b) / 2000 - 1) < 0.03
    assert 2 * len(a & b) / (len(a) + len(b)) > 0.93


@pytest.mark.parametrize("axis", [0, 2])
def test_turns_as_dense(spark, axis):
    mask = pear()
    v = voxels(spark, mask, np.zeros_like(mask), pear(20)[::-1])
    angles = spark.createDataFrame([(0, 35.0), (2, 90.0)], "mask_id long, angle double")
    got = resample.turned(v, angles, mask.shape, axis).toPandas()
    for m, a, angle in ((0, mask, 35), (2, mask[::-1], 90)):
        part = got[got.mask_id == m]
        assert len(part) == len(part.drop_duplicates()) and (masks.dense(part, mask.shape) == moments.rotated(a, angle, axis)).all()
    reference = moments.rotated(mask, 60, axis)
    best = {r.mask_id: r for r in resample.best_turns(v, voxels(spark, reference), mask.shape, axis, step=20).collect()}
    want = moments.rotate_to(reference, spark.createDataFrame([(0,), (2,)], "mask_id long"), v, axis, step=20.0).collect()
    assert sorted((r.mask_id, r.angle, round(r.dice, 12)) for r in want) == sorted((r.mask_id, r.angle, round(r.dice, 12)) for r in best.values())
    assert best[0].angle == 60 and best[0].dice == 1
