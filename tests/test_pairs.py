"""Pairs of many equal masks, which are measured once and handed to all pairs."""

import numpy as np
import pandas as pd
import pytest
from formlens.operators import masks, overlap
from formlens.plans.catalogue import SHAPE

#: Masks as sets of places on a line; of the first there are more than a cell of equal ones holds, of the last two a few; 900 and 901 are empty.
LINES = {**{n: (0, 4) for n in range(600)}, **{n: (2, 7) for n in range(600, 605)}, **{n: (10, 12) for n in range(605, 608)}}


@pytest.fixture(scope="module")
def packed(spark):
    rows = pd.DataFrame([(m, x) for m, (a, b) in LINES.items() for x in range(a, b)], columns=["mask_id", "x"])
    voxel = spark.createDataFrame(rows.assign(y=1, z=2)).selectExpr("mask_id", "int(x) x", "int(y) y", "int(z) z")
    meta = spark.createDataFrame([(m, f"l{m % 2}") for m in [*LINES, 900, 901]], "mask_id long, label string")
    return meta, masks.volumes(meta, voxel), masks.packed(voxel, SHAPE), voxel


def _wanted():
    ids = np.array([*LINES, 900, 901])
    cells = np.zeros((len(ids), 16))
    for n, (a, b) in enumerate(LINES.values()):
        cells[n, a:b] = 1
    size = cells.sum(1)
    total = size[:, None] + size
    return ids, np.where(total > 0, 2 * (cells @ cells.T) / np.maximum(total, 1), 1.0)


def _same(got, digits=12):
    ids, want = _wanted()
    got = got.toPandas()
    place = {m: n for n, m in enumerate(ids)}
    assert len(got) == len(ids) * (len(ids) + 1) // 2 and not got.duplicated(["id_a", "id_b"]).any() and (got["id_a"] <= got["id_b"]).all()
    assert np.abs(got["dice"] - want[got["id_a"].map(place), got["id_b"].map(place)]).max() < 10**-digits


def test_all_pairs_of_equal_masks(packed):
    meta, sizes, words, _ = packed
    _same(overlap.dice_packed(meta, sizes, words))
    _same(overlap.dice_gram(meta, sizes, words))


def test_labels_go_with_their_masks(packed):
    got = overlap.dice_gram(*packed[:3], also=("label",)).toPandas()
    assert (got["label_a"] == "l" + (got["id_a"] % 2).astype(str)).all() and (got["label_b"] == "l" + (got["id_b"] % 2).astype(str)).all()
    _same(overlap.dice_gram(*packed[:3], also=("label",)))


def test_nearest_of_equal_masks(packed):
    ids, want = _wanted()
    got = overlap.nearest_gram(*packed[:3], 3).toPandas().sort_values(["id_a", "rank"])
    for n, m in enumerate(ids):
        best = sorted((-want[n, k], other) for k, other in enumerate(ids) if other != m)[:3]
        own = got[got["id_a"] == m]
        assert list(own["id_b"]) == [b for _, b in best] and np.allclose(own["dice"], [-d for d, _ in best])


def test_sparse_sets(packed, spark):
    meta, voxel = packed[0], packed[3]
    _same(overlap.dice_sparse(meta, voxel, "x"))


def test_blocks_of_pairs(spark):
    rng = np.random.default_rng(1)
    have = rng.random((70, 40)) < 0.1
    rows = spark.createDataFrame([(int(m), int(x)) for m, x in np.argwhere(have)], "mask_id long, x long")
    sizes = spark.createDataFrame([(m, int(have[m].sum())) for m in range(70)], "mask_id long, n long")
    both = have.astype(int) @ have.T
    shared = spark.createDataFrame([(a, b, int(both[a, b])) for a in range(70) for b in range(a, 70) if both[a, b]], "id_a long, id_b long, both long")
    got = overlap._filled(sizes, shared, None, block=16).toPandas()
    assert len(got) == 70 * 71 // 2 and not got.duplicated(["id_a", "id_b"]).any()
    total = have.sum(1)[:, None] + have.sum(1)
    want = np.where(total > 0, 2 * both / np.maximum(total, 1), 1.0)
    assert np.allclose(got["dice"], want[got["id_a"], got["id_b"]])
    assert rows.count() == have.sum()


def test_surfaces_of_equal_masks(packed):
    meta, voxel = packed[0].filter("mask_id > 590"), packed[3].filter("mask_id > 590")
    got = overlap.surface_distances(meta, masks.surface_points(voxel, SHAPE).distinct()).toPandas().set_index(["id_a", "id_b"])
    n = 9 + 5 + 3 + 2
    assert len(got) == n * (n + 1) // 2
    assert (got.loc[[(591, 592), (600, 600)], "hausdorff"] == 0).all() and got.loc[(591, 900)].isna().all()
    assert got.loc[(591, 600), "hausdorff"] == got.loc[(599, 604), "hausdorff"] == 3.0
