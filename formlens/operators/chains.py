"""Whole chains from a mask: blurred surface to point distribution, vector harmonics or Laplace modes, and back to a mask."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sparse
from . import copies, decimation, fields, harmonics, inverse, masks, mesh_modes, meshes, overlap


def blurred_points(voxel: DataFrame, shape: tuple[int, int, int], sigma: float = 1.0, level: float = 0.5, subdivisions: int = 3, iterations: int = 80) -> DataFrame:
    """mask_id, vid, x, y, z: the point distribution of the blurred masks' surfaces."""
    return copies.once(voxel, lambda own: inverse.point_distribution(*fields.level_mesh(own, shape, sigma, level), subdivisions, iterations))


def smooth_points(voxel: DataFrame, shape: tuple[int, int, int], subdivisions: int = 3, iterations: int = 80, samples: int = 50_000, seed: int = 0) -> DataFrame:
    """mask_id, x, y, z: the masks after a round trip through their point distributions."""
    points = blurred_points(voxel, shape, subdivisions=subdivisions, iterations=iterations)
    return inverse.point_voxels(points, shape, subdivisions, samples, seed)


def blurred_vectors(voxel: DataFrame, shape: tuple[int, int, int], lmax: int = 20, sigma: float = 1.0, level: float = 0.5, iterations: int = 100) -> DataFrame:
    """mask_id, centroid, most, l, m, cx, cy, cz: vector harmonics of the blurred surfaces about their mean vertex, over their greatest radius."""
    return inverse.vector_fit(*fields.level_mesh(voxel, shape, sigma, level), lmax, iterations)


def smooth_vectors(voxel: DataFrame, shape: tuple[int, int, int], lmax: int = 20, iterations: int = 100, density: int = 4) -> DataFrame:
    """mask_id, x, y, z: the masks after a round trip through their vector harmonics."""
    return copies.once(voxel, lambda own: inverse.vector_voxels(blurred_vectors(own, shape, lmax, iterations=iterations), None, shape, lmax, density))


def mask_spectra(voxel: DataFrame, shape: tuple[int, int, int], k: int = 100, normalise: bool = False) -> DataFrame:
    """mask_id, eigenvalues of the Laplacians of the masks' own surfaces; normalised as mesh_modes.spectra does."""
    return copies.once(voxel, lambda own: mesh_modes.spectra(meshes.cotangent_laplacian(*fields.level_mesh(own, shape, 0.0)), k, normalise))


def framed(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Vertices about their mean, at scale 1, along their axes by falling variance; the mean, the scale, the axes as columns."""
    centroid = at.mean(0)
    scale = float(np.sqrt(((at - centroid) ** 2).sum(1).mean())) or 1.0
    unit = (at - centroid) / scale
    axes = np.linalg.eigh(np.cov(unit.T))[1][:, ::-1]
    return unit @ axes, centroid, scale, axes


def laplacian_of(at: np.ndarray, corner: np.ndarray) -> sparse.Rows:
    """The cotangent Laplacian of a mesh in one task; meshes.cotangent_laplacian is the same by joins."""
    i, j, w = [], [], []
    for a, b, c in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        u, v, p, q = at[corner[:, b]] - at[corner[:, a]], at[corner[:, c]] - at[corner[:, a]], corner[:, b], corner[:, c]
        cot = (u * v).sum(1) / (np.linalg.norm(np.cross(u, v), axis=1) + 1e-10) / 2
        i, j, w = [*i, p, q, p, q], [*j, q, p, p, q], [*w, -cot, -cot, cot, cot]
    return sparse.Rows(len(at), *(np.concatenate(x) for x in (i, j, w)))


def laplace_chain(voxel: DataFrame, shape: tuple[int, int, int], k: int = 50, target: int = 5000, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """From a mask to its Laplace modes, a row a mask: the surface, drawn together to `target` vertices and put in its frame.

    mask_id; centroid, scale, axes (row major), which restore places; vertices and faces of the mesh; eigenvalues, coefficients
    (three for each mode), modes (an array over the vertices for each) and residual, the largest of a mode over the largest
    entry of the diagonal. A mesh is read once, in one task; its size is bounded by its surface, later by the target.
    """

    def run(v: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        _, at, corner = inverse._mesh(v, f)
        if not len(corner):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in names})
        kept, at, corner = decimation.decimate(at * np.array(spacing), corner, target)
        corner = np.searchsorted(kept, corner)
        at, centroid, scale, axes = framed(at)
        rows = laplacian_of(at, corner)
        values, vectors = sparse.smallest(rows, k)
        off = np.linalg.norm(rows.times(vectors) - vectors * values, axis=0).max() / (np.abs(rows.diagonal()).max() or 1.0)
        row = (int(v["mask_id"].iloc[0]), centroid.tolist(), scale, axes.ravel().tolist(), at.tolist(), corner.tolist(), values.tolist(), (vectors.T @ at).tolist(), vectors.T.tolist(), float(off))
        return pd.DataFrame([row], columns=names)

    kinds = {"mask_id": "long", "centroid": "array<double>", "scale": "double", "axes": "array<double>", "vertices": "array<array<double>>", "faces": "array<array<int>>", "eigenvalues": "array<double>", "coefficients": "array<array<double>>", "modes": "array<array<double>>", "residual": "double"}
    names = list(kinds)
    schema = ", ".join(f"{c} {t}" for c, t in kinds.items())
    return copies.once(voxel, lambda own: inverse._per_mesh(*fields.level_mesh(own, shape, 0.0), run, schema))


def smooth_harmonics(voxel: DataFrame, shape: tuple[int, int, int], lmax: int = 15, fitted: bool = False) -> DataFrame:
    """mask_id, x, y, z: the masks after a round trip through spherical harmonics, expanded over the whole radius map or fitted to its filled cells."""
    found = harmonics.harmonic_coefficients(voxel.select("mask_id").distinct(), voxel, shape, lmax) if fitted else harmonics.expanded_coefficients(voxel, lmax)
    return inverse.harmonic_voxels(found, shape, lmax)


def harmonic_diagnostics(meta: DataFrame, voxel: DataFrame, shape: tuple[int, int, int], lmax: int = 15, fitted: bool = False, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """mask_id, dice, hausdorff, mean_dist of each mask with what its round trip gives; distances in the unit of spacing."""

    def measured(own: DataFrame) -> DataFrame:
        back = smooth_harmonics(own, shape, lmax, fitted)
        return overlap.compared(own.select("mask_id").distinct(), own, back, masks.surface_points(own, shape).distinct(), masks.surface_points(back, shape).distinct(), spacing)

    # A mask without voxels has none after the round trip either.
    rows = meta.select("mask_id").join(copies.once(voxel, measured), "mask_id", "left")
    return rows.withColumn("dice", F.coalesce("dice", F.lit(1.0)))
