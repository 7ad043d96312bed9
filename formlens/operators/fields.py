"""Blurred masks and surfaces of scalar fields at a level, a slab of planes at a time.

A slab's task gets the voxels of its planes and of as many planes beside them as the blur reaches, so each value is whole
and no mask is. Voxels travel once, sparse; the dense field is never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import meshes

#: Cells of a slab, about; its halo comes on top.
SLAB = 1 << 18
#: A value so little below the level is at it, so that the order of sums decides nothing.
NEAR = 1e-12


def kernel(sigma: float) -> np.ndarray:
    """Gaussian weights, cut at 4 sigma; sigma 0 is no blur."""
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2) if sigma > 0 else np.ones(1)
    return w / w.sum()


def blurred(a: np.ndarray, w: np.ndarray, axis: int, before: int, after: int) -> np.ndarray:
    """a convolved along an axis; it grows at either end by so many cells, which mirror those at the end, before it shrinks by the reach."""
    pad = [(0, 0)] * 3
    pad[axis] = (before, after)
    a = np.moveaxis(np.pad(a, pad, mode="symmetric") if before or after else a, axis, 0)
    n = len(a) - len(w) + 1
    return np.moveaxis(sum(x * a[k : k + n] for k, x in enumerate(w)), 0, axis)


def slabs(voxel: DataFrame, shape: tuple[int, int, int], sigma: float, body: Callable[[np.ndarray, int], dict], schema: str, planes: int | None = None) -> DataFrame:
    """mask_id and what body(field, first) gives for each slab of a mask that has voxels near it.

    field holds the blurred mask on planes first to first + planes, both included, one cell beyond the grid on each side,
    where it is 0; body answers for those from first on, but for the last, which is the next slab's first.
    """
    nx, ny, nz = shape
    w = kernel(sigma)
    reach = len(w) // 2
    step = planes or max(2 * reach + 1, SLAB // (ny * nz))
    last = nx // step  # slab s begins at plane s * step - 1
    first, final = F.floor((F.col("x") - reach - step + 1) / step), F.floor((F.col("x") + reach + 1) / step)
    rows = voxel.select("mask_id", "x", "y", "z", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(final, F.lit(last)))).alias("slab"))
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def one(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        p0 = int(key[1]) * step - 1
        c0, c1 = max(p0, 0), min(p0 + step, nx - 1)
        s0, s1 = max(c0 - reach, 0), min(c1 + reach, nx - 1)
        dense = np.zeros((s1 - s0 + 1, ny, nz))
        x = got["x"].to_numpy()
        ok = (x >= s0) & (x <= s1)
        dense[x[ok] - s0, got["y"].to_numpy()[ok], got["z"].to_numpy()[ok]] = 1
        v = blurred(dense, w, 0, reach - (c0 - s0), reach - (s1 - c1))
        v = blurred(blurred(v, w, 1, reach, reach), w, 2, reach, reach)
        field = np.pad(v, ((c0 - p0, p0 + step - c1), (1, 1), (1, 1)))
        return pd.DataFrame({"mask_id": key[0], **body(field, p0)})[["mask_id", *names]]

    return rows.groupBy("mask_id", "slab").applyInPandas(one, f"mask_id long, {schema}")


def gaussian_field(voxel: DataFrame, shape: tuple[int, int, int], sigma: float = 1.0, least: float = 0.0, planes: int | None = None) -> DataFrame:
    """mask_id, x, y, z, v of the cells of each mask's Gaussian blur over `least`; at the grid's border it mirrors the mask."""

    def body(field: np.ndarray, first: int) -> dict:
        inner = field[:-1, 1:-1, 1:-1]
        x, y, z = np.nonzero(inner > least)
        return {"x": x + first, "y": y, "z": z, "v": inner[x, y, z]}

    return slabs(voxel, shape, sigma, body, "x int, y int, z int, v double", planes)


def _cut(field: np.ndarray, first: int, level: float, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The corners of a slab's triangles in half steps, [triangle, corner, axis], and the number of each triangle."""
    inside = field >= level - NEAR
    n = [s - 1 for s in field.shape]
    code = sum((inside[i : i + n[0], j : j + n[1], k : k + n[2]].astype(np.int64) << (4 * i + 2 * j + k)) for i in (0, 1) for j in (0, 1) for k in (0, 1))
    x, y, z = np.nonzero((code > 0) & (code < 255))
    table, codes = meshes._triangles(), code[x, y, z]
    count = np.array([len(t) for t in table])[codes]
    row = np.repeat(np.arange(len(codes)), count)
    at = np.stack([x + first, y - 1, z - 1], 1)[row]
    half = np.concatenate([np.zeros((0, 3, 3), int), *[table[c] for c in codes]]) + 2 * at[:, None, :]
    turn = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    _, ny, nz = shape
    return half, (((at[:, 0] + 1) * (ny + 1) + at[:, 1] + 1) * (nz + 1) + at[:, 2] + 1) * 12 + turn


def _number(half: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    """One long for each place in half steps, so that vertices need not be counted."""
    _, ny, nz = shape
    return ((half[..., 0] + 2) * (2 * ny + 4) + half[..., 1] + 2) * (2 * nz + 4) + half[..., 2] + 2


def level_mesh(voxel: DataFrame, shape: tuple[int, int, int], sigma: float = 1.0, level: float = 0.5, planes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of the surface where the blurred masks are `level`, by marching tetrahedra.

    A vertex lies between two neighbours where the field, linear between them, has the level. Its vid (fid) is made from
    the place of the edge (cell), so slabs number alike without a count or a join. Surfaces are closed, at the grid's
    border too, as the field is 0 beyond it. sigma 0 gives the surface of the mask itself. A mask without voxels, or
    whose blur stays below the level, has no rows.
    """

    def vertices(field: np.ndarray, first: int) -> dict:
        half, _ = _cut(field, first, level, shape)
        half = half.reshape(-1, 3)
        half = half[half[:, 0] < 2 * (first + len(field) - 1)]  # those in the last plane are the next slab's
        vid, at = np.unique(_number(half, shape), return_index=True)
        half = half[at]
        a, b = half // 2, (half + 1) // 2
        va, vb = (field[p[:, 0] - first, p[:, 1] + 1, p[:, 2] + 1] for p in (a, b))
        place = a + (b - a) * np.clip((level - va) / (vb - va), 0, 1)[:, None]
        return {"vid": vid, "x": place[:, 0], "y": place[:, 1], "z": place[:, 2]}

    def faces(field: np.ndarray, first: int) -> dict:
        half, fid = _cut(field, first, level, shape)
        corner = _number(half, shape)
        return {"fid": fid, "i": corner[:, 0], "j": corner[:, 1], "k": corner[:, 2]}

    return (
        slabs(voxel, shape, sigma, vertices, "vid long, x double, y double, z double", planes),
        slabs(voxel, shape, sigma, faces, "fid long, i long, j long, k long", planes),
    )
