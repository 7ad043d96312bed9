from itertools import combinations

import numpy as np
import pytest

from formlens.operators import chains, featurizers, harmonics, hulls, masks, meshes, overlap


def brute(points):
    """Corners by all planes through three points that have all others on one side; the volume by the faces of a fan."""
    corners = set()
    for t in combinations(range(len(points)), 3):
        a, b, c = points[list(t)]
        n = np.cross(b - a, c - a)
        if np.linalg.norm(n) < 1e-12:
            continue
        d = (points - a) @ n
        if (d <= 1e-9).all() or (d >= -1e-9).all():
            corners.update(t)
    return corners


def volume(points, faces):
    a, b, c = points[faces].transpose(1, 0, 2)
    return np.einsum("ij,ij->i", a, np.cross(b, c)).sum() / 6


def outside(points, faces):
    a, b, c = points[faces].transpose(1, 0, 2)
    n = np.cross(b - a, c - a)
    return ((points[None] - a[:, None]) * n[:, None]).sum(2).max()


@pytest.mark.parametrize("seed", range(6))
def test_hull_as_brute_force(seed):
    points = np.random.default_rng(seed).normal(size=(28, 3))
    faces = hulls.hull(points)
    assert set(faces.ravel()) == brute(points) and outside(points, faces) < 1e-9
    edges = {(i, j) for f in faces for i, j in zip(f, np.roll(f, -1), strict=True)}
    assert len(edges) == 3 * len(faces) and {(j, i) for i, j in edges} == edges
    assert len(set(faces.ravel())) - len(edges) // 2 + len(faces) == 2


@pytest.mark.parametrize("seed", range(4))
def test_hull_of_whole_numbers(seed):
    """Many points in the same planes and lines."""
    points = np.argwhere(np.random.default_rng(seed).random((6, 5, 4)) < 0.5).astype(float)
    faces = hulls.hull(points)
    assert outside(points, faces) < 1e-9 and set(faces.ravel()) <= brute(points)
    cube = np.indices((4, 4, 4)).reshape(3, -1).T.astype(float)
    assert volume(cube, hulls.hull(cube)) == pytest.approx(27)
    assert len(hulls.hull(cube[cube[:, 0] == 0])) == len(hulls.hull(cube[:3])) == len(hulls.hull(np.zeros((9, 3)))) == 0


def voxels(spark, *arrays):
    rows = [(m, int(x), int(y), int(z)) for m, a in enumerate(arrays) for x, y, z in np.argwhere(a)]
    return spark.createDataFrame(rows, "mask_id long, x int, y int, z int")


def ball(n, radius):
    g = np.indices((n,) * 3).reshape(3, -1).T - (n - 1) / 2
    return ((g**2).sum(1) <= radius**2).reshape((n,) * 3)


def test_hulls_in_parts(spark):
    """Parts change nothing; a repeated point is one, a flat mask has no faces."""
    rng = np.random.default_rng(3)
    points = rng.normal(size=(300, 3))
    rows = [(0, i, *map(float, p)) for i, p in enumerate(points)] + [(0, 900, *map(float, points[0]))] + [(1, i, float(i), float(i * i), 0.0) for i in range(40)]
    df = spark.createDataFrame(rows, "mask_id long, vid long, x double, y double, z double")
    got = hulls.convex_hulls(df, part=20).toPandas()
    faces = hulls.hull(points)
    assert set(got.mask_id) == {0}
    assert set(got[["i", "j", "k"]].to_numpy().ravel()) == set(faces.ravel())
    assert volume(points, got[["i", "j", "k"]].to_numpy()) == pytest.approx(volume(points, faces))
    assert hulls.convex_hulls(df.limit(0)).count() == 0


def test_weights_and_expansion():
    n = harmonics.POLAR
    w = harmonics.ring_weights(n)
    assert w.sum() == pytest.approx(2)
    p = harmonics.legendre(n // 2 - 1, np.cos(np.arange(n) * np.pi / n))
    for m in (0, 1, 5, 30):
        np.testing.assert_allclose(2 * np.pi * (p[m:, m] * w) @ p[m:, m].T, np.eye(n // 2 - m), atol=1e-10)


def test_expansion_as_sum_and_round_trip(spark):
    """Coefficients are the weighted sums over the map; a large ball, which fills it, comes back."""
    a, b = ball(81, 36.2), np.zeros((81,) * 3, bool)
    b[20:40, 20:30, 25:50] = True
    v = voxels(spark, a, b)
    got = harmonics.expanded_coefficients(v, 6)
    table = harmonics.radius_map(v.filter("mask_id = 1")).toPandas()
    grid = np.zeros((64, 128))
    grid[table.t, table.p] = table.r / 12
    t, p = (x.ravel() for x in np.meshgrid(np.arange(64) * np.pi / 64, np.arange(128) * np.pi / 64, indexing="ij"))
    want = harmonics.real_harmonics(6, t, p).T @ (grid * harmonics.ring_weights(64)[:, None] * np.pi / 64).ravel()
    mine = got.filter("mask_id = 1").toPandas()
    np.testing.assert_allclose(mine.c, want[mine.l**2 + mine.l + mine.m], atol=1e-12)
    with pytest.raises(ValueError, match="lmax"):
        harmonics.expanded_coefficients(v, 32)
    meta = spark.createDataFrame([(0,), (7,)], "mask_id long")
    whole = v.filter("mask_id = 0").persist()
    found = {r.mask_id: r for r in chains.harmonic_diagnostics(meta, whole, a.shape, 6).collect()}
    assert found[0].dice > 0.9 and found[0].mean_dist < 2 and found[7].dice == 1 and found[7].hausdorff is None
    vertices, faces = hulls.harmonic_surface(got.filter("mask_id = 0"), 6)
    told = meshes.measures(vertices, faces).first()
    assert told.open_edges == 0 and told.volume == pytest.approx(a.sum() / 36.0**3, rel=0.15)


def test_compared_as_all_pairs(spark):
    a, b = ball(12, 4.1), np.roll(ball(12, 3.2), 2, 0)
    v = voxels(spark, a, b)
    one, two = v.filter("mask_id = 0"), v.filter("mask_id = 1").withColumn("mask_id", v.mask_id - 1)
    points = [masks.surface_points(x, a.shape).distinct() for x in (one, two)]
    meta = spark.createDataFrame([(0,)], "mask_id long")
    got = overlap.compared(meta, one, two, *points).first()
    want = overlap.surface_distances(v.select("mask_id").distinct(), masks.surface_points(v, a.shape).distinct()).filter("id_a < id_b").first()
    assert got.dice == pytest.approx(2 * (a & b).sum() / (a.sum() + b.sum()))
    assert (got.hausdorff, got.mean_dist) == pytest.approx((want.hausdorff, want.mean_dist))
    sized = overlap.compared(meta, one, two, *points, spacing=(0.7, 0.7, 0.7)).first()
    assert (sized.hausdorff, sized.mean_dist) == pytest.approx((0.7 * want.hausdorff, 0.7 * want.mean_dist))


@pytest.mark.parametrize("fitted", [False, True])
def test_harmonics_by_name(spark, fitted):
    """Decoded features give the mask that the chain gives; a mask without voxels has none."""
    v, meta = voxels(spark, ball(41, 17.2)), spark.range(2).toDF("mask_id")
    rows = featurizers.encode("harmonics", meta, v, (41,) * 3, lmax=5, fitted=fitted)
    assert {r.mask_id: r.features and len(r.features) for r in rows.collect()} == {0: 40, 1: None}
    got = featurizers.decode("harmonics", rows, (41,) * 3, lmax=5, fitted=fitted)
    want = chains.smooth_harmonics(v, (41,) * 3, 5, fitted)
    a, b = (masks.dense(x.toPandas(), (41,) * 3) for x in (got, want))
    assert 2 * (a & b).sum() / (a.sum() + b.sum()) > 0.999
