import numpy as np
import pytest

from formlens.functions import sparse
from formlens.operators import chains, decimation, fields, meshes


def dense(a):
    out = np.zeros((a.n, a.n))
    out[a.i, a.j] = a.w
    return out


def test_rows_and_factor_as_dense():
    rng = np.random.default_rng(0)
    i, j, w = rng.integers(0, 40, 90), rng.integers(0, 40, 90), rng.normal(size=90)
    a = sparse.Rows(41, np.r_[i, j], np.r_[j, i], np.r_[w, w])
    want = np.zeros((41, 41))
    np.add.at(want, (np.r_[i, j], np.r_[j, i]), np.r_[w, w])
    np.testing.assert_allclose(dense(a), want, atol=1e-12)
    x = rng.normal(size=(41, 3))
    np.testing.assert_allclose(a.times(x), want @ x, atol=1e-12)
    assert sorted(np.concatenate(a.levels())) == list(range(41))
    np.testing.assert_allclose((want + 20 * np.eye(41)) @ sparse.Factor(a, 20.0).solve(x), x, atol=1e-9)


@pytest.mark.parametrize("pieces", [1, 2])
def test_smallest_as_dense(pieces):
    """A sphere's eigenvalues come in groups of equal ones; two spheres have each twice, 0 too."""
    v, f = meshes.icosphere(3)
    v, f = np.concatenate([v + 3 * k for k in range(pieces)]), np.concatenate([f + k * len(v) for k in range(pieces)])
    a = chains.laplacian_of(v, f)
    values, vectors = sparse.smallest(a, 30)
    want = np.linalg.eigvalsh(dense(a))[:30]
    np.testing.assert_allclose(values, want, atol=1e-10)
    assert np.abs(a.times(vectors) - vectors * values).max() < 1e-8
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(30), atol=1e-10)


def test_twenty_thousand_vertices():
    """A dense matrix of so many rows has 3.2 GB; the factor here has well under a tenth of it."""
    g = np.stack(np.meshgrid(np.arange(100), np.arange(200), indexing="ij"), -1).reshape(-1, 2)
    at = lambda i, j: (i % 100) * 200 + j % 200
    i, j = g.T
    f = np.concatenate([np.stack([at(i, j), at(i + 1, j), at(i, j + 1)], 1), np.stack([at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)], 1)])
    s, t = 2 * np.pi * i / 100, 2 * np.pi * j / 200
    v = np.stack([(2 + np.cos(s)) * np.cos(t), (2 + np.cos(s)) * np.sin(t), np.sin(s)], 1)
    a = chains.laplacian_of(v, f)
    factor = sparse.Factor(a, 1e-3)
    assert sum(x.nbytes for x in [*factor.inverse, *factor.back]) < 3e8
    values, vectors = sparse.smallest(a, 12)
    assert abs(values[0]) < 1e-10 and values[1] > 1e-6 and (np.diff(values) >= 0).all()
    assert np.linalg.norm(a.times(vectors) - vectors * values, axis=0).max() < 1e-8


@pytest.mark.parametrize("target", [12, 60, 400])
def test_decimation(target):
    v, f = meshes.icosphere(3)
    v = v * [3, 2, 1]
    kept, place, rest = decimation.decimate(v, f, target)
    assert len(kept) == len(place) == target and len(rest) == 2 * target - 4 and set(rest.ravel()) == set(kept)
    edges = np.sort(np.concatenate([rest[:, [0, 1]], rest[:, [1, 2]], rest[:, [2, 0]]]), 1)
    assert (np.unique(edges, axis=0, return_counts=True)[1] == 2).all()
    off = np.abs(np.sqrt(((place / [3, 2, 1]) ** 2).sum(1)) - 1)
    assert off.max() < {12: 0.4, 60: 0.1, 400: 0.02}[target]
    corner = place[np.searchsorted(kept, rest)]
    volume = np.einsum("fi,fi->f", corner[:, 0], np.cross(corner[:, 1], corner[:, 2])).sum() / 6
    assert volume == pytest.approx(4 / 3 * np.pi * 6, rel={12: 0.25, 60: 0.06, 400: 0.02}[target])


def test_decimation_leaves_flat_places_and_borders():
    """A square of many triangles, cut along its middle: the flat inside goes, the border stays."""
    n = 12
    g = np.stack(np.meshgrid(np.arange(n), np.arange(n), [0], indexing="ij"), -1).reshape(-1, 3).astype(float)
    q = np.array([(i * n + j, (i + 1) * n + j, i * n + j + 1, (i + 1) * n + j + 1) for i in range(n - 1) for j in range(n - 1)])
    f = np.concatenate([q[:, [0, 1, 2]], q[:, [1, 3, 2]]])
    kept, place, rest = decimation.decimate(g, f, 0)
    rim = [k for k, (x, y, _) in enumerate(g) if x in (0, n - 1) or y in (0, n - 1)]
    assert set(rim) <= set(kept) and len(kept) < len(rim) + 8 and (place[:, 2] == 0).all()
    corner = place[np.searchsorted(kept, rest)]
    assert np.cross(corner[:, 1] - corner[:, 0], corner[:, 2] - corner[:, 0])[:, 2].sum() / 2 == pytest.approx((n - 1) ** 2)


def test_chains_on_a_ball(spark):
    g = np.indices((19,) * 3).reshape(3, -1).T - 9
    rows = [(0, *map(int, p + 9)) for p in g if (p**2).sum() <= 60] + [(1, 5, 5, 5)]
    voxel = spark.createDataFrame(rows, "mask_id long, x int, y int, z int")
    shape = (19,) * 3
    row = {r.mask_id: r for r in chains.laplace_chain(voxel, shape, 16, 300, (1.0, 1.0, 2.0)).collect()}
    assert len(row[0].vertices) == 300 and len(row[0].modes) == 16 and row[0].residual < 1e-9 and len(row[1].vertices) < 30
    at, axes = np.array(row[0].vertices), np.array(row[0].axes).reshape(3, 3)
    assert abs(at.mean()) < 1e-12 and np.sqrt((at**2).sum(1).mean()) == pytest.approx(1) and at.var(0)[0] > 2 * at.var(0)[1]
    there = at @ axes.T * row[0].scale + row[0].centroid
    radius = np.linalg.norm((there - [9, 9, 18]) / [1, 1, 2], axis=1)
    assert abs(radius - np.sqrt(60)).max() < 1.2  # of voxels
    back = np.array(row[0].modes).T @ np.array(row[0].coefficients)
    assert np.linalg.norm(back - at, axis=1).mean() < 0.12
    vertices, faces = fields.level_mesh(voxel.filter("mask_id = 0"), shape, 1.0)
    smooth = decimation.decimated(vertices, faces, 500)
    assert smooth[0].count() == 500 and smooth[1].count() == 996
    values = chains.mask_spectra(voxel, shape, 9).filter("mask_id = 0").first().eigenvalues
    first, second = np.mean(values[1:4]), np.mean(values[4:9])
    assert abs(values[0]) < 1e-9 and second / first == pytest.approx(3, rel=0.1)
    cot = {(r.i, r.j): r.w for r in meshes.cotangent_laplacian(*smooth).collect()}
    v, f = smooth[0].orderBy("vid").toPandas(), smooth[1].toPandas()
    own = chains.laplacian_of(v[["x", "y", "z"]].to_numpy(), np.searchsorted(v.vid.to_numpy(), f[["i", "j", "k"]].to_numpy()))
    assert {(int(v.vid[i]), int(v.vid[j])) for i, j in zip(own.i, own.j, strict=True)} == set(cot)
    assert max(abs(w - cot[int(v.vid[i]), int(v.vid[j])]) for i, j, w in zip(own.i, own.j, own.w, strict=True)) < 1e-9
