import numpy as np
import pytest

from formlens.operators import cohort_model, masks, meshes, moments, overlap, transforms

SHAPE = (8, 8, 8)


@pytest.fixture(scope="module")
def cohort(spark):
    """0: a cube; 1: the same moved by 3; 2: empty; 3: one voxel; 4: apart from all, at the border."""
    cube = [(x, y, z) for x in range(1, 5) for y in range(2, 6) for z in range(2, 6)]
    cells = [(0, *c) for c in cube] + [(1, x + 3, y, z) for x, y, z in cube] + [(3, 2, 2, 2)] + [(4, 0, 0, z) for z in range(3)]
    meta = spark.createDataFrame([(i, "a", "left" if i == 0 else "right") for i in range(5)], "mask_id long, label string, side string")
    return meta, spark.createDataFrame(cells, "mask_id long, x int, y int, z int")


def test_dice(cohort):
    meta, voxel = cohort
    sizes, words = masks.volumes(meta, voxel), masks.packed(voxel, SHAPE)
    assert {r.mask_id: r.n for r in sizes.collect()} == {0: 64, 1: 64, 2: 0, 3: 1, 4: 3}
    for got in (overlap.dice_packed(meta, sizes, words), overlap.dice_gram(meta, sizes, words, block=2, part=3)):
        dice = {(r.id_a, r.id_b): r.dice for r in got.collect()}
        assert len(dice) == 15 and dice[0, 1] == 0.25 and dice[0, 0] == 1 and dice[2, 2] == 1 and dice[0, 2] == 0 == dice[0, 4]
    assert {(r.id_a, r.id_b): r.dice for r in overlap.dice_packed(meta, sizes, words, 1e-9).collect()}[2, 2] == 0


def test_surfaces(cohort):
    meta, voxel = cohort
    points = masks.surface_points(voxel, SHAPE)
    assert points.filter("mask_id = 4").filter("x2 < 0 or y2 < 0 or z2 < 0").count() == 0
    got = {(r.id_a, r.id_b): (r.hausdorff, r.mean_dist) for r in overlap.surface_distances(meta, points, block=2).collect()}
    assert got[0, 1][0] == 3.0 and got[0, 0] == (0, 0) and got[0, 2] == (None, None) and len(got) == 15
    assert overlap.mirrored(overlap.surface_distances(meta, points)).count() == 25


def test_holes_and_components(cohort):
    meta, voxel = cohort
    shell = voxel.join(masks.erode(voxel), ["mask_id", "x", "y", "z"], "left_anti")
    assert shell.filter("mask_id = 0").count() == 56 and masks.fill_holes(meta, shell, SHAPE).filter("mask_id = 0").count() == 64
    mask = np.zeros((3, 4, 9), bool)
    mask[0, 0], mask[2, 3, 2:4], mask[1, 0, 8] = True, True, True
    label = masks._labels(mask)
    assert sorted(np.unique(label[mask], return_counts=True)[1].tolist()) == [2, 10] and (label[~mask] == -1).all()


def test_distances():
    rng = np.random.default_rng(1)
    mask = rng.random((6, 7, 5)) < 0.2
    at = np.argwhere(mask)
    want = ((np.argwhere(np.ones(mask.shape)).reshape(-1, 1, 3) - at) ** 2).sum(2).min(1).reshape(mask.shape)
    assert (transforms.squared_distances(mask) == want).all()
    d = transforms.signed_distances(mask)
    assert (d[mask] < 0).all() and (d[~mask] > 0).all() and np.abs(d).min() == 1
    assert transforms.squared_distances(np.zeros((2, 2, 2), bool)).min() == transforms.FAR


def test_cosine_round_trip():
    mask = np.zeros((6, 5, 7), bool)
    mask[1:4, 2:4, 1:5] = True
    assert (transforms.mask_of(transforms.dct_of(mask, 7, False, None), mask.shape, 7, False) == mask).all()
    with pytest.raises(ValueError):
        transforms.mask_of(np.zeros(3), mask.shape, 7, False)


def test_polynomials():
    assert [tuple(x) for x in transforms.total_degree(1)] == [(0, 0, 0), (0, 0, 1), (0, 1, 0), (1, 0, 0)] and len(transforms.total_degree(15)) == 816
    grid = np.indices((16, 16, 16)) - 8
    ball = (grid**2).sum(0) <= 20
    c, centre, scale = transforms.polynomial_fit(ball, 8, True, 1e-3)
    back = transforms.polynomial_mask(c, ball.shape, 8, True, centre, scale)
    assert 2 * (back & ball).sum() / (back.sum() + ball.sum()) > 0.95


def test_frames():
    points = np.argwhere(np.ones((9, 5, 3)))
    centre, axes, values = moments.principal_frame(points)
    assert np.allclose(centre, (4, 2, 1)) and np.isclose(np.linalg.det(axes), 1) and (np.diff(values) < 0).all()
    with pytest.raises(ValueError):
        moments.principal_frame(points[:2])
    mask = np.zeros((9, 9, 9), bool)
    mask[4, 1:8, 3:5] = True
    assert (moments.rotated(mask, 0, 2) == mask).all() and (moments.rotated(moments.rotated(mask, 90, 2), 270, 2) == mask).all()


def test_turning_ties_take_the_smallest_angle(cohort):
    meta, voxel = cohort
    reference = np.zeros(SHAPE, bool)
    reference[2:6, 2:6, 2:6] = True
    got = {r.mask_id: (r.angle, r.dice) for r in moments.rotate_to(reference, meta, voxel, step=90.0).collect()}
    assert got[2] == (0.0, 0.0) and got[4] == (0.0, 0.0) and got[0][0] == 0.0


def test_components_of_few_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4, 6))
    features = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "mask_id long, features array<double>")
    model = cohort_model.fit(features)
    assert len(model.components) == 4 and np.isclose(model.ratio.sum(), 1) and (np.take_along_axis(model.components[:3], np.abs(model.components[:3]).argmax(1)[:, None], 1) > 0).all()
    scores = cohort_model.scores(features, model)
    assert all(r.coeffs[3] is None and r.coeffs[0] is not None for r in scores.collect())
    back = {r.mask_id: r.features for r in cohort_model.reconstructed(scores, model).collect()}
    assert np.allclose([back[i] for i in range(4)], x)


def test_dual_components_are_the_primal_ones(spark, monkeypatch):
    x = np.random.default_rng(4).standard_normal((9, 23)) + 1e5
    features = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "mask_id long, features array<double>").repartition(3)
    one = cohort_model.fit(features, dual=False)
    monkeypatch.setattr(cohort_model, "SLICE", 7)
    two = cohort_model.fit(features, dual=True)
    values = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2 / 8
    assert np.allclose(one.variance[:8], values[:8]) and np.allclose(two.variance, values[:8]) and len(two.variance) == 8
    assert np.allclose(one.components[:8], two.components, atol=1e-6) and np.allclose(two.mean, x.mean(0)) and np.allclose(one.ratio[:8], two.ratio)
    scores = cohort_model.scores(features, one).first().coeffs
    assert scores[8] is None and scores[7] is not None


def test_dct_of_a_mask_without_a_surface_is_null(spark, cohort):
    meta, voxel = cohort
    got = {r.mask_id: r.features for r in transforms.dct_features(meta, voxel, SHAPE, order=3).collect()}
    assert got[2] is None and len(got[0]) > 0


def test_surface_meshes(spark, cohort):
    _, voxel = cohort
    vertices, faces = meshes.surface_mesh(voxel)
    told = {r.mask_id: r for r in meshes.measures(vertices, faces).collect()}
    assert set(told) == {0, 1, 3, 4} and all(r.euler == 2 and r.open_edges == 0 and r.volume > 0 for r in told.values())
    assert abs(told[0].volume - told[1].volume) < 1e-9 and told[3].volume < 1  # the same cube; one voxel
    back = {tuple(r) for r in meshes.inside_mesh(vertices, faces, SHAPE).select("mask_id", "x", "y", "z").collect()}
    assert back == {tuple(r) for r in voxel.select("mask_id", "x", "y", "z").collect()}
    corners = meshes.surface_corners(voxel)
    again = {r.mask_id: r for r in meshes.measures(vertices, corners).collect()}
    assert all(np.allclose(tuple(again[m]), tuple(r)) for m, r in told.items())
    at = {(r.mask_id, r.vid): (r.x, r.y, r.z) for r in vertices.collect()}
    faced = corners.collect()
    assert all(at[r.mask_id, v] == p for r in faced for v, p in ((r.i, (r.ax, r.ay, r.az)), (r.j, (r.bx, r.by, r.bz)), (r.k, (r.cx, r.cy, r.cz))))
    assert len({(r.mask_id, r.fid) for r in faced}) == len(faced) and len(set(at)) == vertices.count()
    order = sorted((v, p) for (m, v), p in at.items() if m == 0)
    assert [p for _, p in order] == sorted(p for _, p in order)  # numbers are in the order of x, y, z
    moved = meshes.surface_corners(voxel.select("mask_id", *[(voxel[c] - 40).alias(c) for c in "xyz"]))
    assert moved.agg({"ax": "min"}).first()[0] == corners.agg({"ax": "min"}).first()[0] - 40 and moved.select("fid").distinct().count() == corners.select("fid").distinct().count()
    assert meshes.surface_mesh(voxel.limit(0))[0].count() == 0


def test_sparse_dice_is_that_of_words(spark):
    items = [(i, j) for i in range(6) for j in range(40) if (i * 7 + j * j) % 5 == 0 and i != 3]
    rows = spark.createDataFrame([*items, *items[:3]], "mask_id long, z long")
    meta = spark.createDataFrame([(i,) for i in range(6)], "mask_id long")
    got = {(r.id_a, r.id_b): r.dice for r in overlap.dice_sparse(meta, rows, "z").collect()}
    sets = [{j for i, j in items if i == k} for k in range(6)]
    assert got == {(a, b): 2 * len(sets[a] & sets[b]) / (len(sets[a]) + len(sets[b])) if sets[a] or sets[b] else 1.0 for a in range(6) for b in range(a, 6)}
