"""Moments, principal axes and alignment of masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linear import eigenvalues
from .masks import per_mask

_PAIRS = ("xx", "yy", "zz", "xy", "xz", "yz")


def covariances(voxel: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """mask_id, n, centroid m_x, m_y, m_z and sample covariances c_xx ... c_yz (null for one voxel), in physical units."""
    at = {c: F.col(c) * F.lit(float(s)) for c, s in zip("xyz", spacing, strict=True)}
    means = [F.avg(at[c]).alias(f"m_{c}") for c in "xyz"]
    return voxel.groupBy("mask_id").agg(F.count("*").alias("n"), *means, *[F.covar_samp(at[p[0]], at[p[1]]).alias(f"c_{p}") for p in _PAIRS])


def principal_variances(voxel: DataFrame) -> DataFrame:
    """mask_id, l1 >= l2 >= l3: eigenvalues of the covariance; null for masks of fewer than 3 voxels."""
    rows = covariances(voxel)
    values = eigenvalues(*[F.col(f"c_{p}") for p in _PAIRS])
    return rows.select("mask_id", *[F.when(F.col("n") >= 3, v).alias(f"l{i}") for i, v in enumerate(values, 1)])


def weighted_inertia(volume: DataFrame, least_mass: float = 1e-12) -> DataFrame:
    """Of volume (mask_id, x, y, z, v): mass, weighted centroid and second moments about it, not divided by the mass."""
    w = F.col("v")
    sums = volume.filter("v != 0").groupBy("mask_id").agg(
        F.sum(w).alias("mass"), *[F.sum(w * F.col(c)).alias(f"s_{c}") for c in "xyz"], *[F.sum(w * F.col(p[0]) * F.col(p[1])).alias(f"s_{p}") for p in _PAIRS])
    sums = sums.filter(F.col("mass") > least_mass)
    return sums.select("mask_id", "mass", *[(F.col(f"s_{c}") / F.col("mass")).alias(f"m_{c}") for c in "xyz"],
                       *[(F.col(f"s_{p}") - F.col(f"s_{p[0]}") * F.col(f"s_{p[1]}") / F.col("mass")).alias(f"i_{p}") for p in _PAIRS])


def _centred(voxel: DataFrame) -> DataFrame:
    """Voxels with integer offsets dx, dy, dz from the centroid, times the number of voxels, so all is exact."""
    sums = voxel.groupBy("mask_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in "xyz"])
    return voxel.join(sums, "mask_id").select("mask_id", *[(F.col("n") * F.col(c) - F.col(f"s_{c}")).cast("double").alias(f"d{c}") for c in "xyz"])


def cone_orientation(voxel: DataFrame, axis: tuple[float, float, float] = (0.0, 0.0, 1.0), cone_degrees: float = 90.0) -> DataFrame:
    """mask_id, forward, backward (voxels in the double cone about axis), skew, flip: whether axis is turned to the lighter side."""
    length = sum(x * x for x in axis) ** 0.5
    rows = _centred(voxel)
    along = sum(F.col(f"d{c}") * (a / length) for c, a in zip("xyz", axis, strict=True))
    norm2 = F.expr("dx * dx + dy * dy + dz * dz")
    cos2 = round(float(np.cos(np.deg2rad(cone_degrees / 2)) ** 2), 12)
    rows = rows.select("mask_id", along.alias("along"), norm2.alias("norm2"))
    inside = (F.col("norm2") > 0) & (F.col("along") * F.col("along") >= cos2 * F.col("norm2"))
    counts = rows.groupBy("mask_id").agg(F.count_if(inside & (F.col("along") > 0)).alias("forward"), F.count_if(inside & (F.col("along") < 0)).alias("backward"))
    total = F.col("forward") + F.col("backward")
    return counts.select("*", F.coalesce(F.try_divide(F.abs(F.col("forward") - F.col("backward")), total), F.lit(0.0)).alias("skew"), (F.col("forward") > F.col("backward")).alias("flip"))


def cone_sweep(voxel: DataFrame, cone_degrees: float = 30.0, step: int = 1) -> DataFrame:
    """mask_id, min_mass, n_directions, vx, vy: of all directions in the first two axes' plane, those whose lighter half cone is lightest, and their mean towards it."""
    rows = _centred(voxel).withColumn("degrees", F.explode(F.sequence(F.lit(0), F.lit(179), F.lit(step))))
    rows = rows.withColumn("ux", F.cos(F.radians("degrees"))).withColumn("uy", F.sin(F.radians("degrees")))
    rows = rows.withColumn("along", F.expr("dx * ux + dy * uy")).withColumn("norm2", F.expr("dx * dx + dy * dy + dz * dz"))
    cos2 = float(np.cos(np.deg2rad(cone_degrees / 2)) ** 2)
    rows = rows.filter((F.col("norm2") > 0) & (F.col("along") * F.col("along") >= cos2 * F.col("norm2")))
    sides = rows.groupBy("mask_id", "degrees").agg(F.count_if(F.col("along") < 0).alias("left"), F.count_if(F.col("along") >= 0).alias("right"), F.first("ux").alias("ux"), F.first("uy").alias("uy"))
    lighter = F.least("left", "right")
    sign = F.when(F.col("left") < F.col("right"), -1.0).otherwise(1.0)
    sides = sides.select("mask_id", lighter.alias("mass"), (sign * F.col("ux")).alias("ux"), (sign * F.col("uy")).alias("uy"))
    least = sides.groupBy("mask_id").agg(F.min("mass").alias("min_mass"))
    return sides.join(least, "mask_id").filter("mass = min_mass").groupBy("mask_id").agg(F.first("min_mass").alias("min_mass"), F.count("*").alias("n_directions"), F.avg("ux").alias("vx"), F.avg("uy").alias("vy"))


def principal_frame(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroid, axes (columns, largest variance first, right-handed) and variances of at least three points."""
    if len(points) < 3:
        raise ValueError("principal axes need three voxels")
    centre = points.mean(0)
    values, axes = np.linalg.eigh(np.cov((points - centre).T))
    values, axes = values[::-1], axes[:, ::-1].copy()
    if np.linalg.det(axes) < 0:
        axes[:, 2] *= -1
    return centre, axes, values


def _towards_lighter(points: np.ndarray, centre: np.ndarray, v: np.ndarray, degrees: float) -> tuple[np.ndarray, float]:
    d = points - centre
    norm = np.linalg.norm(d, axis=1)
    d, norm = d[norm > 1e-9], norm[norm > 1e-9]
    along = d @ v
    inside = np.abs(along) >= np.cos(np.deg2rad(degrees / 2)) * norm
    ahead, behind = int((along[inside] > 0).sum()), int((along[inside] < 0).sum())
    return (-v if ahead > behind else v), abs(ahead - behind) / max(1, ahead + behind)


def canonical_frame(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroid and axes x, y, z as columns: z the principal axis against -y, x the more skewed of the others."""
    centre, axes, _ = principal_frame(points)
    z = axes[:, 0] if axes[:, 0] @ np.array([0.0, -1.0, 0.0]) >= 0 else -axes[:, 0]
    (v1, skew1), (v2, skew2) = (_towards_lighter(points, centre, axes[:, k], 90.0) for k in (1, 2))
    x = v1 if skew1 > skew2 else v2
    return centre, np.stack([x, np.cross(z, x), z], 1)


def canonical_axes(meta: DataFrame, voxel: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """mask_id, cx, cy, cz and axes (9 doubles, row-major, columns x, y, z) of masks of three voxels or more."""

    def body(_: int, mask: np.ndarray) -> Iterator[dict]:
        points = np.argwhere(mask).astype(float)
        if len(points) >= 3:
            centre, axes = canonical_frame(points)
            yield {"cx": centre[:1], "cy": centre[1:2], "cz": centre[2:], "axes": [axes.ravel().tolist()]}

    return per_mask(meta, voxel, shape, body, "mask_id long, cx double, cy double, cz double, axes array<double>")


def normalised(meta: DataFrame, voxel: DataFrame, shape: tuple[int, int, int], size: int = 301, volume: float = 1e6, spacing: float = 1.0) -> DataFrame:
    """mask_id, x, y, z of each mask in its canonical frame, scaled to `volume`, on a grid of size**3 cells of `spacing` about its centroid."""

    def body(_: int, mask: np.ndarray) -> Iterator[dict]:
        points = np.argwhere(mask).astype(float)
        if len(points) < 3:
            return
        centre, axes = canonical_frame(points)
        scale = (volume / len(points)) ** (1 / 3)
        at = (np.arange(size) - (size - 1) / 2) * spacing / scale
        for k in range(size):  # one slab of the new grid at a time
            x, y = np.meshgrid(at, at, indexing="ij")
            source = np.rint(np.stack([np.full_like(x, at[k]), x, y], -1) @ axes.T + centre).astype(int)
            ok = ((source >= 0) & (source < np.array(mask.shape))).all(-1)
            source[~ok] = 0
            i, j = np.nonzero(ok & mask[source[..., 0], source[..., 1], source[..., 2]])
            yield {"x": np.full(len(i), k), "y": i, "z": j}

    return per_mask(meta, voxel, shape, body, "mask_id long, x int, y int, z int")


def rotated(mask: np.ndarray, degrees: float, axis: int) -> np.ndarray:
    """mask turned about the grid's centre in the plane across axis, by the nearest source voxel; 0 outside."""
    a, b = [k for k in range(3) if k != axis]
    c, s = np.round([np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))], 15)
    grid = list(np.indices(mask.shape))
    u, v = grid[a] - (mask.shape[a] - 1) / 2, grid[b] - (mask.shape[b] - 1) / 2
    grid[a] = np.floor(c * u + s * v + (mask.shape[a] - 1) / 2 + 0.5).astype(int)
    grid[b] = np.floor(-s * u + c * v + (mask.shape[b] - 1) / 2 + 0.5).astype(int)
    ok = (grid[a] >= 0) & (grid[a] < mask.shape[a]) & (grid[b] >= 0) & (grid[b] < mask.shape[b])
    grid[a], grid[b] = np.where(ok, grid[a], 0), np.where(ok, grid[b], 0)
    return mask[tuple(grid)] & ok


def rotate_to(reference: np.ndarray, meta: DataFrame, voxel: DataFrame, axis: int = 2, start: float = 0.0, end: float = 360.0, step: float = 1.0) -> DataFrame:
    """mask_id, angle, dice: the first of the angles at which each mask overlaps the reference most."""
    size = int(reference.sum())

    def body(_: int, mask: np.ndarray) -> Iterator[dict]:
        best = (-1.0, 0.0)
        for angle in np.arange(start, end, step):
            turned = rotated(mask, angle, axis)
            n = size + int(turned.sum())
            dice = 2.0 * int((turned & reference).sum()) / n if n else 1.0
            if dice > best[0]:
                best = (dice, float(angle))
        yield {"angle": [best[1]], "dice": [best[0]]}

    return per_mask(meta, voxel, reference.shape, body, "mask_id long, angle double, dice double")
