"""Spherical descriptors of masks: radius maps, spherical harmonics, power spectra and Zernike moments."""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .masks import per_mask

#: Cells of a radius map, in polar and azimuth angle.
POLAR, AZIMUTH = 64, 128


def radius_map(voxel: DataFrame) -> DataFrame:
    """mask_id, t, p, r: the greatest distance from the centroid of the voxels in each cell of the sphere."""
    sums = voxel.groupBy("mask_id").agg(*[F.avg(c).alias(f"m_{c}") for c in "xyz"])
    rows = voxel.join(sums, "mask_id").select("mask_id", *[(F.col(c) - F.col(f"m_{c}")).alias(f"d{c}") for c in "xyz"])
    rows = rows.withColumn("r", F.sqrt(F.expr("dx * dx + dy * dy + dz * dz"))).filter("r > 0")
    polar = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("dz") / F.col("r"))))
    azimuth = F.pmod(F.atan2("dy", "dx"), 2 * F.pi())
    cell = [F.floor(polar / F.pi() * (POLAR - 1)).cast("int").alias("t"), F.floor(azimuth / (2 * F.pi()) * (AZIMUTH - 1)).cast("int").alias("p")]
    return rows.select("mask_id", *cell, "r").groupBy("mask_id", "t", "p").agg(F.max("r").alias("r"))


def legendre(lmax: int, x: np.ndarray) -> np.ndarray:
    """Normalised associated Legendre functions [l, m, point], so that the real harmonics are orthonormal on the sphere."""
    out = np.zeros((lmax + 1, lmax + 1, len(x)))
    out[0, 0] = np.sqrt(1 / (4 * np.pi))
    s = np.sqrt(np.maximum(0.0, 1 - x * x))
    for m in range(lmax + 1):
        if m:
            out[m, m] = np.sqrt((2 * m + 1) / (2 * m)) * s * out[m - 1, m - 1]
        if m < lmax:
            out[m + 1, m] = np.sqrt(2 * m + 3) * x * out[m, m]
        for n in range(m + 2, lmax + 1):
            a = np.sqrt((4 * n * n - 1) / (n * n - m * m))
            b = np.sqrt(((n - 1) ** 2 - m * m) / (4 * (n - 1) ** 2 - 1))
            out[n, m] = a * (x * out[n - 1, m] - b * out[n - 2, m])
    return out


def real_harmonics(lmax: int, polar: np.ndarray, azimuth: np.ndarray) -> np.ndarray:
    """[point, (lmax + 1)**2]: for each l, m from -l to l; sines for negative m."""
    p = legendre(lmax, np.cos(polar))
    columns = []
    for n in range(lmax + 1):
        for m in range(-n, n + 1):
            turn = np.sin(-m * azimuth) if m < 0 else np.cos(m * azimuth)
            columns.append((np.sqrt(2.0) if m else 1.0) * p[n, abs(m)] * turn)
    return np.stack(columns, 1)


def _directions(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.linalg.norm(points, axis=1)
    return r, np.arccos(np.clip(points[:, 2] / np.maximum(r, 1e-300), -1, 1)), np.arctan2(points[:, 1], points[:, 0]) % (2 * np.pi)


def _radii(mask: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray, np.ndarray]:
    """Centroid, half of the largest side, and the polar angle, azimuth and radius of each filled cell."""
    at = np.argwhere(mask).astype(float)
    centre, extent = at.mean(0), max(1.0, (at.max(0) - at.min(0)).max() / 2)
    r, polar, azimuth = _directions(at - centre)
    ok = r > 0
    t, p = (polar[ok] / np.pi * (POLAR - 1)).astype(int), (azimuth[ok] / (2 * np.pi) * (AZIMUTH - 1)).astype(int)
    best = np.zeros((POLAR, AZIMUTH))
    np.maximum.at(best, (t, p), r[ok] / extent)
    t, p = np.nonzero(best)
    return centre, extent, t / (POLAR - 1) * np.pi, p / (AZIMUTH - 1) * 2 * np.pi, best[t, p]


def harmonic_coefficients(meta: DataFrame, voxel: DataFrame, shape: tuple[int, int, int], lmax: int = 15) -> DataFrame:
    """mask_id, l, m, c, and the centroid and extent that the radii are scaled by: a least-squares fit of the radius map."""

    def body(_: int, mask: np.ndarray) -> Iterator[dict]:
        if mask.sum() < 2:
            return
        centre, extent, polar, azimuth, r = _radii(mask)
        a = real_harmonics(lmax, polar, azimuth)
        c = np.linalg.solve(a.T @ a + 1e-9 * np.eye(a.shape[1]), a.T @ r)
        degree = [(n, m) for n in range(lmax + 1) for m in range(-n, n + 1)]
        yield {"l": [n for n, _ in degree], "m": [m for _, m in degree], "c": c, "centroid": [centre.tolist()] * len(c), "extent": extent}

    return per_mask(meta, voxel, shape, body, "mask_id long, l int, m int, c double, centroid array<double>, extent double")


def ring_weights(n: int) -> np.ndarray:
    """Weights of n rings at the polar angles pi t / n, t from 0 on, that make sums over the cosine exact up to degree n - 1."""
    angle, odd = np.arange(n) * np.pi / n, np.arange(1, n, 2)
    return 4 / n * np.sin(angle) * (np.sin(np.outer(angle, odd)) / odd).sum(1)


def expanded_coefficients(voxel: DataFrame, lmax: int = 15) -> DataFrame:
    """mask_id, l, m, c, centroid, extent: the expansion of the whole radius map by quadrature, on masks of two voxels or more.

    A cell's radius stands at its ring's and column's first angle; empty cells count as radius 0, so a mask should fill
    the map, or harmonic_coefficients, which fits the filled cells, be used. Each ring is a Fourier sum, the rings are
    added by their weights, which is exact up to degree 31, the most that a map of 64 rings holds. Times the root of
    4 pi these are coefficients in the norm in which degree 0 is the mean radius.
    """
    if not 0 <= lmax < POLAR // 2:
        raise ValueError(f"lmax must be from 0 to {POLAR // 2 - 1}")
    sizes = voxel.groupBy("mask_id").agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in "xyz"]).alias("centroid"),
                                         (F.greatest(F.lit(2), *[F.max(c) - F.min(c) for c in "xyz"]) / 2.0).alias("extent")).filter("n >= 2").drop("n")
    weighted = legendre(lmax, np.cos(np.arange(POLAR) * np.pi / POLAR)) * ring_weights(POLAR) * (2 * np.pi / AZIMUTH)
    degree = [(n, m) for n in range(lmax + 1) for m in range(-n, n + 1)]

    def expand(got: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((POLAR, AZIMUTH))
        grid[got["t"], got["p"]] = got["r"] / got["extent"]
        rings = np.fft.rfft(grid, axis=1)
        c = [np.sqrt(2.0 if m else 1.0) * weighted[n, abs(m)] @ (-rings[:, -m].imag if m < 0 else rings[:, m].real) for n, m in degree]
        first = got.iloc[0]
        return pd.DataFrame({"mask_id": first["mask_id"], "l": [n for n, _ in degree], "m": [m for _, m in degree], "c": c, "centroid": [first["centroid"]] * len(c), "extent": first["extent"]})

    # The map has at most 64 x 128 cells a mask.
    return radius_map(voxel).join(sizes, "mask_id").groupBy("mask_id").applyInPandas(expand, "mask_id long, l int, m int, c double, centroid array<double>, extent double")


def power_spectrum(coefficients: DataFrame) -> DataFrame:
    """mask_id, l, power: the root of the sum of squares of a degree's coefficients."""
    return coefficients.groupBy("mask_id", "l").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("power"))


def radial_terms(n: int, m: int) -> list[tuple[float, int]]:
    """Factors and powers of r of the radial polynomial of degree n and order m."""
    if m > n or (n - m) % 2:
        return []
    return [((-1) ** s * factorial(n - s) / (factorial(s) * factorial((n + m) // 2 - s) * factorial((n - m) // 2 - s)), n - 2 * s) for s in range((n - m) // 2 + 1)]


def radial_polynomial(n: int, m: int, r: Column) -> Column:
    return sum((F.lit(float(c)) * F.pow(r, F.lit(float(p))) for c, p in radial_terms(n, m)), F.lit(0.0))


def zernike_moments(meta: DataFrame, voxel: DataFrame, shape: tuple[int, int, int], n_max: int) -> DataFrame:
    """mask_id, n, m, l, re, im: sums over the voxels, scaled to the unit ball about the centroid, of the conjugate basis.

    For l - |m| even and n = l, l + 2, ... The centroid's own voxel is left out; a mask of one voxel has moment 1 at 0.
    """

    def body(_: int, mask: np.ndarray) -> Iterator[dict]:
        points = np.argwhere(mask).astype(float)
        if not len(points):
            return
        d = points - points.mean(0)
        r, polar, azimuth = _directions(d)
        if r.max() <= 1e-9:
            yield {"n": [0], "m": [0], "l": [0], "re": [float(len(points))], "im": [0.0]}
            return
        ok = r > 1e-9
        r, polar, azimuth = r[ok] / r.max(), polar[ok], azimuth[ok]
        p = legendre(n_max, np.cos(polar))
        for l in range(n_max + 1):  # noqa: E741
            for m in range(-l, l + 1):
                if (l - abs(m)) % 2:
                    continue
                sign = (-1) ** m if m >= 0 else 1
                y = sign * p[l, abs(m)] * np.exp(-1j * m * azimuth)
                for n in range(l, n_max + 1, 2):
                    a = (sum(c * r**q for c, q in radial_terms(n, l)) * y).sum()
                    yield {"n": [n], "m": [m], "l": [l], "re": [a.real], "im": [a.imag]}

    return per_mask(meta, voxel, shape, body, "mask_id long, n int, m int, l int, re double, im double")
