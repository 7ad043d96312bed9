import numpy as np
import pytest

from formlens.operators import masks


def voxels(spark, *arrays):
    rows = [(m, int(x), int(y), int(z)) for m, a in enumerate(arrays) for x, y, z in np.argwhere(a)]
    return spark.createDataFrame(rows, "mask_id long, x int, y int, z int")


def snake(shape):
    """One line of voxels up and down through all planes, so slabs hold many parts of one component."""
    a = np.zeros(shape, bool)
    a[:, ::2, 2] = True
    for n, y in enumerate(range(1, shape[1] - 1, 2)):
        a[-1 if n % 2 == 0 else 0, y, 2] = True
    return a


def vessel(shape):
    """A closed shell with a wall inside, and one that a hole in its last plane opens."""
    a = np.zeros(shape, bool)
    a[1:-1, 1:4, 1:4] = True
    a[2:-2, 2, 2] = False
    b = a.copy()
    b[-2, 2, 2] = False
    return a, b


@pytest.mark.parametrize("planes", [1, 2, 5, None])
def test_slabs_as_dense(spark, planes):
    shape = (12, 7, 6)
    rng = np.random.default_rng(7)
    arrays = [rng.random(shape) < 0.35, snake(shape), *vessel(shape), np.zeros(shape, bool), rng.random(shape) < 0.75]
    v, meta = voxels(spark, *arrays), spark.range(len(arrays)).toDF("mask_id")
    got = masks.components(meta, v, shape, planes).toPandas()
    full = masks.fill_holes(meta, v, shape, planes).toPandas()
    for m, a in enumerate(arrays):
        part = got[got.mask_id == m]
        label = np.full(shape, -1)
        label[part.x, part.y, part.z] = part.component
        assert len(part) == a.sum() and (label == masks._labels(a)).all()
        part = full[full.mask_id == m]
        assert len(part) == len(part.drop_duplicates()) and (masks.dense(part, shape) == masks.fill_holes_of(a)).all()
    assert len(full[full.mask_id == 2]) > arrays[2].sum() and len(full[full.mask_id == 3]) == arrays[3].sum()
