import json

import numpy as np
import pytest

from formlens.operators import featurizers
from formlens.sources import archives

SHAPE = (12, 11, 13)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("masks")
    ball = ((np.indices(SHAPE) - 6) ** 2).sum(0) <= 12
    for name, mask in {"one": ball, "none": np.zeros(SHAPE, np.uint8), "two": np.roll(ball, 1, 2).astype(np.int16)}.items():
        np.savez_compressed(folder / f"{name}.npz", mask=mask, other=np.arange(3))
    (folder / "notes.txt").write_text("not a mask")
    return folder, ball


def test_archives_and_tables(spark, stored, tmp_path):
    folder, ball = stored
    archives.write_tables(*archives.read_npz(spark, str(folder)), str(tmp_path / "cohort"))
    archives.write_tables(*archives.read_npz(spark, str(folder)), str(tmp_path / "cohort"))  # written anew, not twice
    meta, voxel = archives.read_tables(spark, str(tmp_path / "cohort"))
    ids = {r.label: r.mask_id for r in meta.collect()}
    assert set(ids) == {"one", "none", "two"} and all(tuple(r.shape) == SHAPE and r.spacing == [1, 1, 1] for r in meta.collect())
    cells = {(r.mask_id, r.x, r.y, r.z) for r in voxel.collect()}
    assert cells == {(ids["one"], *map(int, c)) for c in np.argwhere(ball)} | {(ids["two"], *map(int, c)) for c in np.argwhere(np.roll(ball, 1, 2))}


def test_missing_key_and_axes_are_errors(spark, stored):
    folder, _ = stored
    for key, text in (("nothing", "no nothing"), ("other", "three axes")):
        with pytest.raises(Exception, match=text):
            archives.read_npz(spark, str(folder), key)[0].collect()


@pytest.mark.parametrize(("name", "parameters"), [("dct", {"order": 8}), ("cheby", {"order": 6}), ("points", {"subdivisions": 2})])
def test_featurizers(spark, stored, name, parameters):
    folder, ball = stored
    meta, voxel = archives.read_npz(spark, str(folder))
    table = featurizers.encode(name, meta, voxel, SHAPE, **parameters).cache()
    rows = {r.label: r for r in table.collect()}
    assert set(rows) == {"one", "none", "two"} and rows["none"].features is None and len(rows["one"].features) == len(rows["two"].features) > 0
    used = json.loads(rows["one"].parameters)
    assert parameters.items() <= used.items() and len(used) > len(parameters) and rows["one"].original_shape == list(SHAPE)
    more = {"samples": 3000} if name == "points" else {}
    back = {(r.x, r.y, r.z) for r in featurizers.decode(name, table.filter("label = 'one'"), SHAPE, **parameters, **more).collect()}
    want = {tuple(map(int, c)) for c in np.argwhere(ball)}
    # Points come back with two cells more around them.
    assert 2 * len(back & want) / (len(back) + len(want)) > (0.35 if name == "points" else 0.9)
