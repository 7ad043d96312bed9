"""Masks as voxel tables (mask_id, x, y, z): packing, volumes, flips, morphology, surfaces, and per-mask functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import cut

#: Cells of a slab whose parts are labelled at once, about.
SLAB = 1 << 21
#: The six neighbours that share a face.
FACES = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


def packed(voxel: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """mask_id, word, bits: 64 voxels a word, in C order."""
    _, ny, nz = shape
    at = (F.col("x").cast("long") * ny + F.col("y")) * nz + F.col("z")
    bit = F.expr("shiftleft(1L, cast(pmod(at, 64) as int))")
    return voxel.select("mask_id", at.alias("at")).groupBy("mask_id", F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))


def volumes(meta: DataFrame, voxel: DataFrame) -> DataFrame:
    """Every mask of meta with its number of voxels n (0 if none)."""
    counts = voxel.groupBy("mask_id").agg(F.count("*").alias("n"))
    return meta.select("mask_id").join(counts, "mask_id", "left").select("mask_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def bounding_boxes(voxel: DataFrame) -> DataFrame:
    bounds = [f(c).alias(f"{name}_{c}") for c in "xyz" for f, name in ((F.min, "min"), (F.max, "max"))]
    return voxel.groupBy("mask_id").agg(F.count("*").alias("n"), *bounds)


def flip_left(meta: DataFrame, voxel: DataFrame, nx: int) -> DataFrame:
    """Left masks mirrored along the first axis, so that all are right ones."""
    sided = voxel.join(meta.select("mask_id", "side"), "mask_id")
    return sided.select("mask_id", F.when(F.col("side") == "left", nx - 1 - F.col("x")).otherwise(F.col("x")).alias("x"), "y", "z")


def _ball(radius: int, euclidean: bool) -> list[tuple[int, int, int]]:
    r = range(-radius, radius + 1)
    return [(i, j, k) for i in r for j in r for k in r if (i * i + j * j + k * k <= radius * radius if euclidean else abs(i) + abs(j) + abs(k) <= radius)]


def _spread(voxel: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """Each voxel moved by each offset."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in offsets]))
    return voxel.withColumn("o", steps).select("mask_id", *[(F.col(c) + F.col(f"o.{o}")).alias(c) for c, o in zip("xyz", "ijk", strict=True)])


def dilate(voxel: DataFrame, shape: tuple[int, int, int], radius: int = 1, euclidean: bool = False) -> DataFrame:
    inside = [F.col(c).between(0, n - 1) for c, n in zip("xyz", shape, strict=True)]
    return _spread(voxel, _ball(radius, euclidean)).filter(inside[0] & inside[1] & inside[2]).distinct()


def erode(voxel: DataFrame, radius: int = 1, euclidean: bool = False) -> DataFrame:
    """Voxels whose whole neighbourhood is set; outside the grid nothing is."""
    ball = _ball(radius, euclidean)
    return _spread(voxel, ball).groupBy("mask_id", "x", "y", "z").agg(F.count("*").alias("n")).filter(F.col("n") == len(ball)).drop("n")


def close(voxel: DataFrame, shape: tuple[int, int, int], radius: int = 1, euclidean: bool = False) -> DataFrame:
    return erode(dilate(voxel, shape, radius, euclidean), radius, euclidean)


def surface_points(voxel: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """mask_id, x2, y2, z2: midpoints, in half voxels, between set voxels and unset face neighbours in the grid.

    A neighbour outside the grid makes no point, so a mask that touches the border is open there.
    """
    marked = voxel.withColumn("own", F.lit(1))
    ways = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("ijk", o, strict=True)]) for o in FACES]))
    beside = voxel.withColumn("o", ways)
    beside = beside.select("mask_id", *[(F.col(c) + F.col(f"o.{o}")).alias(c) for c, o in zip("xyz", "ijk", strict=True)], *[(2 * F.col(c) + F.col(f"o.{o}")).alias(f"{c}2") for c, o in zip("xyz", "ijk", strict=True)])
    inside = [F.col(c).between(0, n - 1) for c, n in zip("xyz", shape, strict=True)]
    beside = beside.filter(inside[0] & inside[1] & inside[2])
    return beside.join(marked, ["mask_id", "x", "y", "z"], "left_anti").select("mask_id", "x2", "y2", "z2")


def dense(voxel: pd.DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    out = np.zeros(shape, bool)
    out[voxel["x"].to_numpy(), voxel["y"].to_numpy(), voxel["z"].to_numpy()] = True
    return out


def per_mask(meta: DataFrame, voxel: DataFrame, shape: tuple[int, int, int], body: Callable[[int, np.ndarray], Iterator[dict]], schema: str) -> DataFrame:
    """body(mask_id, array) for each mask of meta, empty ones too; it gives columns as dicts of equal-length arrays."""

    def of(m: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        names = [x.strip().split(" ")[0] for x in schema.split(",")]
        nothing = pd.DataFrame({n: pd.Series([], dtype=object) for n in names})  # of any type, arrays too
        if not len(m):
            return nothing
        parts = [pd.DataFrame({"mask_id": m["mask_id"].iloc[0], **x}) for x in body(int(m["mask_id"].iloc[0]), dense(v, shape))]
        return pd.concat(parts)[names] if parts else nothing

    # New columns, as both sides may come from the same table.
    ids, cells = meta.select("mask_id").distinct().toDF("mask_id"), voxel.select("mask_id", "x", "y", "z").toDF("mask_id", "x", "y", "z")
    return ids.groupBy("mask_id").cogroup(cells.groupBy("mask_id")).applyInPandas(of, schema)


def _labels(mask: np.ndarray) -> np.ndarray:
    """Components by shared faces: each voxel's component is the least index in it; -1 outside."""
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape), mask.size)
    while True:
        old = label
        pad = np.pad(label, 1, constant_values=mask.size)
        near = [pad[1 + i : pad.shape[0] - 1 + i, 1 + j : pad.shape[1] - 1 + j, 1 + k : pad.shape[2] - 1 + k] for i, j, k in FACES]
        label = np.where(mask, np.minimum.reduce([label, *near]), mask.size)
        flat = np.append(label.ravel(), mask.size)
        label = np.where(mask, flat[label], mask.size)  # jump to the label of the label
        if (label == old).all():
            return np.where(mask, label, -1)


def fill_holes_of(mask: np.ndarray) -> np.ndarray:
    """The mask with the background that no path of faces joins to the border."""
    out = _labels(~mask)
    rim = np.ones(mask.shape, bool)
    rim[1:-1, 1:-1, 1:-1] = False
    open_ = np.unique(out[rim & ~mask])
    return mask | ~np.isin(out, open_) & ~mask


def _slab_labels(meta: DataFrame, voxel: DataFrame, shape: tuple[int, int, int], step: int, holes: bool) -> DataFrame:
    """mask_id, x, y, z, label: the parts of each slab of `step` planes, named by their least C-order index.

    With holes the background is labelled in place of the mask: parts that reach the grid's border are -1, and of those
    only the cells of a slab's first and last plane are given. A slab beside one with voxels takes part too.
    """
    nx, ny, nz = shape
    cells = voxel.select("mask_id", "x", "y", "z", F.floor(F.col("x") / step).alias("slab"))
    cells = cells.join(meta.select("mask_id").distinct(), "mask_id", "left_semi").toDF("mask_id", "x", "y", "z", "slab")
    slabs = cells.select("mask_id", "slab").distinct()
    if holes:
        slabs = slabs.select("mask_id", F.explode(F.array(F.col("slab") - 1, F.col("slab"), F.col("slab") + 1)).alias("slab")).filter(F.col("slab").between(0, (nx - 1) // step)).distinct()
    slabs = slabs.toDF("mask_id", "slab")

    def label(key: tuple, m: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        first = int(key[1]) * step
        planes = min(step, nx - first)
        mask = dense(v.assign(x=v["x"] - first), (planes, ny, nz))
        if not holes:
            out = _labels(mask)
            keep = mask
        elif not len(v):
            out, keep = np.full(mask.shape, -1), np.zeros_like(mask)
            keep[[0, -1]] = True
        else:
            out = _labels(~mask)
            rim = np.zeros(mask.shape, bool)
            rim[:, [0, -1], :] = rim[:, :, [0, -1]] = True
            rim[0] |= first == 0
            rim[-1] |= first + planes == nx
            out = np.where(np.isin(out, np.unique(out[rim & ~mask])), -1, out)
            keep = ~mask & (out >= 0)
            keep[[0, -1]] = ~mask[[0, -1]]
        x, y, z = np.nonzero(keep)
        found = out[x, y, z].astype(np.int64)
        return pd.DataFrame({"mask_id": key[0], "x": x + first, "y": y, "z": z, "label": np.where(found < 0, -1, found + first * ny * nz)})

    return slabs.groupBy("mask_id", "slab").cogroup(cells.groupBy("mask_id", "slab")).applyInPandas(label, "mask_id long, x int, y int, z int, label long")


def _roots(edges: DataFrame) -> DataFrame:
    """mask_id, label, root: the least label that edges (mask_id, a, b) lead to, for all but the least; by large and small stars in turn."""
    edges = cut(edges.select("mask_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select("mask_id", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("mask_id", "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, ["mask_id", "a"]).select("mask_id", F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        least = large.groupBy("mask_id", "a").agg(F.min("b").alias("m"))
        star = large.join(least, ["mask_id", "a"]).select("mask_id", F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(star.unionByName(least.select("mask_id", "a", F.col("m").alias("b"))).filter("a != b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("mask_id", "a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select("mask_id", F.col("a").alias("label"), F.col("b").alias("root"))
        before = now


def _joined_labels(meta: DataFrame, voxel: DataFrame, shape: tuple[int, int, int], planes: int | None, holes: bool) -> DataFrame:
    """Slabs' labels, with `component`, the least label of what meets through the slabs' faces."""
    step = planes or max(1, SLAB // (shape[1] * shape[2]))
    found = _slab_labels(meta, voxel, shape, step, holes)
    if shape[0] <= step:
        return found.withColumn("component", F.col("label"))
    ends = found.filter(F.col("x") % step == step - 1).select("mask_id", (F.col("x") + 1).alias("x"), "y", "z", F.col("label").alias("a"))
    begins = found.filter(F.col("x") % step == 0).select("mask_id", "x", "y", "z", F.col("label").alias("b"))
    roots = _roots(ends.join(begins, ["mask_id", "x", "y", "z"]).select("mask_id", "a", "b").distinct())
    return found.join(roots, ["mask_id", "label"], "left").withColumn("component", F.coalesce("root", "label")).drop("root")


def components(meta: DataFrame, voxel: DataFrame, shape: tuple[int, int, int], planes: int | None = None) -> DataFrame:
    """mask_id, x, y, z, component: the least C-order index of the voxel's face-connected component.

    Slabs of planes are labelled by themselves and parts that meet at their faces joined, so no mask is whole in a task.
    """
    return _joined_labels(meta, voxel, shape, planes, False).select("mask_id", "x", "y", "z", "component")


def preprocess(meta: DataFrame, voxel: DataFrame, shape: tuple[int, int, int], min_size: int = 1000, closing_radius: int = 2) -> DataFrame:
    """Small components dropped, gaps closed by a ball, holes filled."""
    parts = components(meta, voxel, shape)
    large = parts.groupBy("mask_id", "component").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size).select("mask_id", "component")
    kept = parts.join(large, ["mask_id", "component"], "left_semi").select("mask_id", "x", "y", "z")
    return fill_holes(meta, close(kept, shape, closing_radius, euclidean=True), shape)


def fill_holes(meta: DataFrame, voxel: DataFrame, shape: tuple[int, int, int], planes: int | None = None) -> DataFrame:
    """The masks of meta with the background that no path of faces joins to the grid's border, slab by slab as components."""
    holes = _joined_labels(meta, voxel, shape, planes, True).filter("component >= 0").select("mask_id", "x", "y", "z")
    own = voxel.join(meta.select("mask_id").distinct(), "mask_id", "left_semi").select("mask_id", "x", "y", "z").distinct()
    return own.unionByName(holes)
