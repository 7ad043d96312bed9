"""Masks of different voxel sizes brought into one frame and grid, by trilinear values, and turned to a reference.

Sums over voxels give the frames. The new grid is made in cubes: a task gets the voxels whose tents reach its cube, so
that neither the old mask nor the new one is whole anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.linear import dot

#: Cells along a cube's side.
CUBE = 32
#: A value so little above the level is at it, so that the order of sums decides nothing.
NEAR = 1e-9
_PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


def _world(voxel: DataFrame, meta: DataFrame) -> DataFrame:
    """voxel with world coordinates px, py, pz: the index times the mask's dx, dy, dz of meta, or 1 where it has none."""
    size = {c: F.coalesce(F.col(f"d{c}").cast("double"), F.lit(1.0)) if f"d{c}" in meta.columns else F.lit(1.0) for c in "xyz"}
    known = meta.select("mask_id", *[size[c].alias(f"s{c}") for c in "xyz"]).dropDuplicates(["mask_id"])
    return voxel.select("mask_id", "x", "y", "z").join(known, "mask_id").select("*", *[(F.col(c) * F.col(f"s{c}")).alias(f"p{c}") for c in "xyz"])


def principal_frames(voxel: DataFrame, meta: DataFrame) -> DataFrame:
    """mask_id, n, spacing, centre, axes (the principal ones, an array of three unit vectors, largest variance first), of masks of three voxels or more."""
    world = _world(voxel, meta)
    sums = world.groupBy("mask_id").agg(F.count("*").alias("n"), F.first(F.array("sx", "sy", "sz")).alias("spacing"), F.array(*[F.avg(f"p{c}") for c in "xyz"]).alias("centre"),
                                        F.array(*[F.covar_samp(f"p{a}", f"p{b}") for a, b in _PAIRS]).alias("c")).filter("n >= 3")

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for got in frames:
            if len(got):
                c = np.stack(got["c"])[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
                axes = np.linalg.eigh(c)[1][:, :, ::-1].transpose(0, 2, 1)  # rows are axes
                peak = np.take_along_axis(axes, np.abs(axes).argmax(2)[..., None], 2)
                axes = axes * np.where(peak < 0, -1.0, 1.0)
                yield got.drop(columns="c").assign(axes=[[v.tolist() for v in a] for a in axes])

    return sums.mapInPandas(solve, "mask_id long, n long, spacing array<double>, centre array<double>, axes array<array<double>>")


def canonical_frames(voxel: DataFrame, meta: DataFrame, cone_degrees: float = 90.0) -> DataFrame:
    """The principal frames with axes x, y, z: z the first one, against -y; x that of the others whose cones differ more, to its lighter side; y = z times x.

    Where both halves of a cone weigh the same, the axis's largest entry is positive.
    """
    frames = principal_frames(voxel, meta)
    at = F.array(*[F.col(f"p{c}") - F.col("centre")[i] for i, c in enumerate("xyz")])
    rows = _world(voxel, meta).join(frames.select("mask_id", "centre", "axes"), "mask_id").select("mask_id", at.alias("d"), "axes")
    rows = rows.select("mask_id", F.sqrt(dot(F.col("d"), F.col("d"))).alias("r"), *[dot(F.col("d"), F.col("axes")[k]).alias(f"a{k}") for k in (1, 2)])
    cosine = float(np.cos(np.deg2rad(cone_degrees / 2)))
    inside = {k: (F.col("r") > 1e-9) & (F.abs(f"a{k}") >= cosine * F.col("r") - 1e-9) for k in (1, 2)}
    counts = rows.groupBy("mask_id").agg(*[F.count_if(inside[k] & (F.col(f"a{k}") > 0)).alias(f"ahead{k}") for k in (1, 2)], *[F.count_if(inside[k] & (F.col(f"a{k}") < 0)).alias(f"behind{k}") for k in (1, 2)])
    skew = {k: F.abs(F.col(f"ahead{k}") - F.col(f"behind{k}")) / F.greatest(F.lit(1), F.col(f"ahead{k}") + F.col(f"behind{k}")) for k in (1, 2)}
    turn = lambda k: F.transform(F.col("axes")[k], lambda v: F.when(F.col(f"ahead{k}") > F.col(f"behind{k}"), -v).otherwise(v))
    z = F.transform(F.col("axes")[0], lambda v: F.when(F.col("axes")[0][1] > 1e-9, -v).otherwise(v))
    got = frames.join(counts, "mask_id").select("mask_id", "n", "spacing", "centre", z.alias("z"), F.when(skew[1] > skew[2], turn(1)).otherwise(turn(2)).alias("x"))
    cross = F.array(*[F.col("z")[i] * F.col("x")[j] - F.col("z")[j] * F.col("x")[i] for i, j in ((1, 2), (2, 0), (0, 1))])
    return got.select("mask_id", "n", "spacing", "centre", F.array("x", cross, "z").alias("axes"))


def resampled(voxel: DataFrame, frames: DataFrame, size: int, spacing: float = 1.0, level: float = 0.5, cube: int = CUBE) -> DataFrame:
    """mask_id, x, y, z, value: the cells of a grid of size**3 about each frame's centre whose trilinear value is above level.

    frames: mask_id, spacing (world size of the old voxels), centre, axes (three unit vectors across each other, in world
    coordinates) and scale, by which the mask grows. Beyond the old voxels the value is 0. level must not be negative.
    """
    k = {i: F.col("scale") / spacing for i in range(3)}
    rows = voxel.select("mask_id", "x", "y", "z").join(frames.select("mask_id", "spacing", "centre", "axes", "scale"), "mask_id")
    world = F.array(*[F.col(c) * F.col("spacing")[i] - F.col("centre")[i] for i, c in enumerate("xyz")])
    rows = rows.select("*", world.alias("w"))
    for i, c in enumerate("xyz"):
        middle = dot(F.col("axes")[i], F.col("w")) * k[i] + (size - 1) / 2
        reach = dot(F.transform(F.col("axes")[i], lambda v: F.abs(v)), F.col("spacing")) * k[i] + 1e-6
        first, last = F.greatest(F.ceil(middle - reach), F.lit(0)), F.least(F.floor(middle + reach), F.lit(size - 1))
        rows = rows.withColumn(f"f{c}", first).withColumn(f"l{c}", last).filter(F.col(f"f{c}") <= F.col(f"l{c}"))
    for c in "xyz":
        rows = rows.withColumn(f"b{c}", F.explode(F.sequence(F.floor(F.col(f"f{c}") / cube), F.floor(F.col(f"l{c}") / cube))))
    # A cube's task has the frame once for each voxel; frames are short.
    rows = rows.select("mask_id", "bx", "by", "bz", "x", "y", "z", "spacing", "centre", F.flatten("axes").alias("axes"), "scale")

    def gather(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        frame = got.iloc[0]
        step, centre, axes = np.asarray(frame["spacing"]), np.asarray(frame["centre"]), np.asarray(frame["axes"]).reshape(3, 3)
        old = got[["x", "y", "z"]].to_numpy()
        low = old.min(0) - 1
        dense = np.zeros(old.max(0) - low + 2)
        dense[tuple((old - low).T)] = 1.0
        begin = np.array(key[1:]) * cube
        end = np.minimum(begin + cube, size)
        out = []
        for x in range(begin[0], end[0]):  # a plane of the cube at a time
            y, z = (a.ravel() for a in np.meshgrid(np.arange(begin[1], end[1]), np.arange(begin[2], end[2]), indexing="ij"))
            new = (np.stack([np.full(len(y), x), y, z], 1) - (size - 1) / 2) * spacing / frame["scale"]
            at = (new @ axes + centre) / step - low
            base = np.floor(at).astype(int)
            part = at - base
            ok = ((base >= 0) & (base < np.array(dense.shape) - 1)).all(1)
            base, part = base[ok], part[ok]
            value = np.zeros(len(base))
            for i, j, m in np.ndindex(2, 2, 2):
                weight = np.where([i, j, m], part, 1 - part).prod(1)
                value += weight * dense[base[:, 0] + i, base[:, 1] + j, base[:, 2] + m]
            keep = value > level + NEAR
            out.append(np.column_stack([np.full(keep.sum(), x), y[ok][keep], z[ok][keep], value[keep]]))
        out = np.concatenate(out)
        return pd.DataFrame({"mask_id": key[0], "x": out[:, 0].astype(int), "y": out[:, 1].astype(int), "z": out[:, 2].astype(int), "value": out[:, 3]})

    return rows.groupBy("mask_id", "bx", "by", "bz").applyInPandas(gather, "mask_id long, x int, y int, z int, value double")


def _turned(voxel: DataFrame, shape: tuple[int, int, int], axis: int, *keep: str) -> DataFrame:
    """voxel, which has an angle, turned in the plane across axis: a cell is set if the voxel nearest to where it comes from is.

    Each voxel offers itself to the cells about its own new place, and only those that come from it take it.
    """
    a, b = [i for i in range(3) if i != axis]
    names = "xyz"
    mid = {i: (shape[i] - 1) / 2 for i in (a, b)}
    c, s = (F.round(f(F.radians(F.col("angle"))), 15) for f in (F.cos, F.sin))
    rows = voxel.withColumns({"c": c, "s": s}).withColumns({"u": F.col(names[a]) - mid[a], "v": F.col(names[b]) - mid[b]})
    near = range(-1, 2)
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in near for j in near]))
    rows = rows.withColumn("o", steps)
    rows = rows.withColumn("na", F.rint(F.col("c") * F.col("u") - F.col("s") * F.col("v") + mid[a]) + F.col("o.i")).withColumn("nb", F.rint(F.col("s") * F.col("u") + F.col("c") * F.col("v") + mid[b]) + F.col("o.j"))
    ua, vb = F.col("na") - mid[a], F.col("nb") - mid[b]
    source: dict[int, Column] = {a: F.floor(F.col("c") * ua + F.col("s") * vb + mid[a] + 0.5), b: F.floor(-F.col("s") * ua + F.col("c") * vb + mid[b] + 0.5)}
    rows = rows.filter((source[a] == F.col(names[a])) & (source[b] == F.col(names[b])) & F.col("na").between(0, shape[a] - 1) & F.col("nb").between(0, shape[b] - 1))
    new = {a: F.col("na").cast("int"), b: F.col("nb").cast("int"), axis: F.col(names[axis])}
    return rows.select("mask_id", *keep, *[new[i].alias(names[i]) for i in range(3)])


def best_turns(voxel: DataFrame, reference: DataFrame, shape: tuple[int, int, int], axis: int = 2, start: int = 0, end: int = 360, step: int = 5) -> DataFrame:
    """mask_id, angle, dice: the first of the angles at which a mask overlaps the reference (x, y, z) most; masks without voxels have no row."""
    angles = F.explode(F.sequence(F.lit(start), F.lit(end - 1), F.lit(step))).alias("angle")
    moved = _turned(voxel.select("mask_id", "x", "y", "z", angles), shape, axis, "angle")
    marked = reference.select("x", "y", "z").distinct().withColumn("own", F.lit(1))
    size = marked.count()
    counts = moved.join(marked, ["x", "y", "z"], "left").groupBy("mask_id", "angle").agg(F.count("*").alias("n"), F.count("own").alias("both"))
    every = voxel.select("mask_id").distinct().select("mask_id", angles)  # at an angle a mask can leave the grid
    rows = every.join(counts, ["mask_id", "angle"], "left")
    rows = rows.select("mask_id", "angle", F.coalesce(2.0 * F.col("both") / (F.col("n") + size), F.lit(0.0)).alias("dice"))
    best = F.min_by(F.struct("angle", "dice"), F.struct(-F.col("dice"), "angle"))
    return rows.groupBy("mask_id").agg(best.alias("b")).select("mask_id", F.col("b.angle").cast("double").alias("angle"), F.col("b.dice").alias("dice"))


def turned(voxel: DataFrame, angles: DataFrame, shape: tuple[int, int, int], axis: int = 2) -> DataFrame:
    """mask_id, x, y, z: each mask turned by its angle about the grid's middle."""
    return _turned(voxel.select("mask_id", "x", "y", "z").join(angles.select("mask_id", "angle"), "mask_id"), shape, axis)


def normalised(voxel: DataFrame, meta: DataFrame, size: int = 301, volume: float = 1e6, spacing: float = 1.0, reference: DataFrame | None = None, cube: int = CUBE) -> DataFrame:
    """mask_id, x, y, z: masks of three voxels or more in their canonical frame, of the same volume, on one grid about their centre.

    meta gives voxel sizes dx, dy, dz; left masks (side) should be mirrored before, as flip_left does. With a reference
    (x, y, z, on the same grid) each is turned about its z axis to where it overlaps that most, in steps of 5 degrees.
    """
    frames = canonical_frames(voxel, meta)
    own = F.col("n") * F.col("spacing")[0] * F.col("spacing")[1] * F.col("spacing")[2]
    new = resampled(voxel, frames.withColumn("scale", F.cbrt(volume / own)), size, spacing, cube=cube).drop("value")
    if reference is None:
        return new
    shape = (size,) * 3
    return turned(new, best_turns(new, reference, shape), shape)
