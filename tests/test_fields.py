import numpy as np
import pytest

from formlens.operators import chains, fields, masks, meshes


def voxels(spark, *arrays):
    rows = [(m, int(x), int(y), int(z)) for m, a in enumerate(arrays) for x, y, z in np.argwhere(a)]
    return spark.createDataFrame(rows, "mask_id long, x int, y int, z int")


def ball(n, radius, at=None):
    g = np.indices((n,) * 3).reshape(3, -1).T - (np.full(3, (n - 1) / 2) if at is None else at)
    return ((g**2).sum(1) <= radius**2).reshape((n,) * 3)


def blur(a, sigma):
    """Each cell as the weighted sum over all cells, mirrored at the borders."""
    out = a.astype(float)
    w = fields.kernel(sigma)
    r = len(w) // 2
    for axis in range(3):
        n = out.shape[axis]
        m = np.zeros((n, n))
        for t in range(n):
            for k in range(-r, r + 1):
                s = (t + k) % (2 * n)
                m[t, s if s < n else 2 * n - 1 - s] += w[k + r]
        out = np.moveaxis(np.tensordot(m, np.moveaxis(out, axis, 0), 1), 0, axis)
    return out


@pytest.mark.parametrize(("sigma", "planes"), [(1.0, None), (1.0, 3), (0.0, 2), (2.5, 1)])
def test_blur_as_dense(spark, sigma, planes):
    a = np.random.default_rng(3).random((11, 9, 7)) < 0.3
    b = np.zeros_like(a)
    b[10, 8, 6] = True
    got = fields.gaussian_field(voxels(spark, a, b), a.shape, sigma, planes=planes).toPandas()
    for m, mask in enumerate((a, b)):
        v = np.zeros(a.shape)
        part = got[got.mask_id == m]
        v[part.x, part.y, part.z] = part.v
        assert len(part) == len(part.drop_duplicates(["x", "y", "z"]))
        np.testing.assert_allclose(v, blur(mask, sigma), atol=1e-12)


@pytest.mark.parametrize("planes", [None, 1, 4])
def test_level_mesh_of_a_ball(spark, planes):
    """The blurred ball's surface is smooth: vertices are within 0.2 of its radius, which is within a quarter of a voxel."""
    vertices, faces = fields.level_mesh(voxels(spark, ball(21, 7.3), ball(9, 20)), (21,) * 3, planes=planes)
    v = vertices.filter("mask_id = 0").toPandas()
    radius = np.linalg.norm(v[["x", "y", "z"]] - 10, axis=1)
    assert radius.max() - radius.min() < 0.4 and abs(radius.mean() - 7.3) < 0.25
    got = {r.mask_id: r for r in meshes.measures(vertices, faces).collect()}
    assert got[0].euler == 2 and got[0].open_edges == 0 and got[1].open_edges == 0 and got[1].euler == 2
    assert got[0].volume == pytest.approx(4 / 3 * np.pi * radius.mean() ** 3, rel=0.01)
    assert got[0].area == pytest.approx(4 * np.pi * radius.mean() ** 2, rel=0.02)
    assert faces.select("mask_id", "fid").distinct().count() == faces.count()


def test_level_mesh_without_blur_is_the_surface_of_voxels(spark):
    a = np.random.default_rng(5).random((6, 5, 4)) < 0.4
    v = voxels(spark, a)
    vertices, faces = fields.level_mesh(v, a.shape, 0.0, planes=2)
    old = meshes.surface_mesh(v)
    place = lambda df: sorted((r.x, r.y, r.z) for r in df.collect())
    assert place(vertices) == place(old[0]) and faces.count() == old[1].count()
    assert fields.level_mesh(v.limit(0), a.shape)[0].count() == 0
    assert fields.level_mesh(voxels(spark, ball(5, 0.1)), (5,) * 3)[1].count() == 0  # one voxel's blur stays below the level


def dice(a, b):
    return 2 * (a & b).sum() / (a.sum() + b.sum())


def test_chains_give_the_shape_back(spark):
    g = np.indices((24,) * 3).reshape(3, -1).T - 11.5
    bean = ((g / [8, 6, 7]) ** 2).sum(1) <= 1
    bean &= ((g - [9, 0, 0]) ** 2).sum(1) > 9
    bean = bean.reshape((24,) * 3)
    v = voxels(spark, bean)
    centred = np.argwhere(bean).mean(0) - 12  # the point distribution forgets where it was
    grown = masks.dense(masks.dilate(masks.dilate(v, bean.shape), bean.shape).toPandas(), bean.shape)  # both paint by two cells
    got = masks.dense(chains.smooth_vectors(v, bean.shape, lmax=8).toPandas(), bean.shape)
    assert dice(got, grown) > 0.93
    got = masks.dense(chains.smooth_points(v, bean.shape, subdivisions=2, samples=20_000).toPandas(), bean.shape)
    moved = np.roll(grown, tuple(-np.round(centred).astype(int)), (0, 1, 2))
    assert dice(got, moved) > 0.85
