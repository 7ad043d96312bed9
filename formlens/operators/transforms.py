"""Signed distances, cosine transforms and polynomial bases of masks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .masks import per_mask

#: Squared distance where there is nothing to be near to.
FAR = 1 << 40
_FAR32 = 1 << 30
#: Cells of a block of distances, about.
BLOCK = 1 << 18


def envelope(f: np.ndarray) -> np.ndarray:
    """Of each line along the first axis, at each place p the least f[q] + (p - q)^2; FAR where all of a line are.

    The parabolas' lower envelope by a stack for each line, all lines at once: linear in the cells.
    """
    shape, f = f.shape, np.ascontiguousarray(f).reshape(len(f), -1)
    n, lines = f.shape
    apex, start, top = np.zeros((n, lines), np.int64), np.zeros((n, lines), np.int64), np.full(lines, -1)
    for u in range(n):
        new = np.flatnonzero(f[u] < FAR)
        left = new[top[new] >= 0]
        while len(left):  # those whose last parabola is above the new one where it begins lose it
            q, s = apex[top[left], left], start[top[left], left]
            left = left[f[q, left] + (s - q) ** 2 > f[u, left] + (s - u) ** 2]
            top[left] -= 1
            left = left[top[left] >= 0]
        some = top[new] >= 0
        q = apex[np.maximum(top[new], 0), new]
        begin = np.where(some, 1 + (u * u - q * q + f[u, new] - f[q, new]) // (2 * np.maximum(u - q, 1)), 0)
        new, begin = new[begin < n], begin[begin < n]
        top[new] += 1
        apex[top[new], new], start[top[new], new] = u, begin
    out, at, every = np.full((n, lines), FAR, np.int64), np.maximum(top, 0), np.arange(lines)
    some = top >= 0
    for p in range(n - 1, -1, -1):
        q = apex[at, every]
        out[p, some] = (f[q, every] + (p - q) ** 2)[some]
        at -= (start[at, every] == p) & (at > 0)
    return np.minimum(out, FAR).reshape(shape)


def squared_distances(targets: np.ndarray) -> np.ndarray:
    """Each cell's exact squared distance to the nearest target: along one axis after the other, the least sum."""
    out = np.where(targets, 0, FAR).astype(np.int64)
    for axis in range(out.ndim):
        out = np.moveaxis(envelope(np.moveaxis(out, axis, 0)), 0, axis)
    return out


def signed_squares(mask: np.ndarray) -> np.ndarray:
    """Squared distances to the mask outside, minus those to its outside in it."""
    return np.where(mask, -squared_distances(~mask), squared_distances(mask))


def signed_distances(mask: np.ndarray) -> np.ndarray:
    d = signed_squares(mask).astype(np.float64)
    return np.sign(d) * np.sqrt(np.abs(d))


def distance_blocks(meta: DataFrame, voxel: DataFrame, shape: tuple[int, int, int], body: Callable[..., dict], schema: str, cells: int = BLOCK, known: tuple[str, ...] = ()) -> DataFrame:
    """mask_id and what body(y0, d2, **known) gives for each block of every mask of meta: d2[x, y - y0, z] are its signed squared distances.

    known: columns of meta, one value a mask, that travel with its planes.

    Planes of x are made alone, along z and y, and dealt out again in blocks of a few y and all x, where the envelope
    along x ends the distances. So a task holds a plane or about `cells` cells, no mask, and the field is shuffled once, as four
    bytes a cell. A mask without voxels is FAR everywhere, one without background -FAR.
    """
    nx, ny, nz = shape
    rows, together = max(1, cells // (nx * nz)), max(1, cells // (ny * nz))
    planes = voxel.groupBy("mask_id", "x").agg(F.collect_list((F.col("y") * nz + F.col("z")).cast("int")).alias("at"))
    every = meta.select("mask_id", *known).dropDuplicates(["mask_id"]).select("mask_id", *known, F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("x"))

    def along(planes: np.ndarray) -> np.ndarray:
        """Squared distances in each plane [plane, y, z] to its targets."""
        d = np.where(planes, 0, FAR).astype(np.int64)
        return np.moveaxis(envelope(np.moveaxis(np.moveaxis(envelope(np.moveaxis(d, 2, 0)), 0, 2), 1, 0)), 0, 1)

    def flat(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), together):
                part = frame.iloc[start : start + together]
                own = np.zeros((len(part), ny * nz), bool)
                for k, at in enumerate(part["at"]):
                    if at is not None:
                        own[k, at] = True
                own = own.reshape(-1, ny, nz)
                d = np.minimum(np.where(own, along(~own), along(own)), _FAR32)
                d = np.where(own, -d, d).astype(np.int32)
                for block in range(0, ny, rows):
                    yield pd.DataFrame({"mask_id": part["mask_id"], **{c: part[c] for c in known}, "block": block, "x": part["x"], "d": [x.tobytes() for x in d[:, block : block + rows]]})

    parts = every.join(planes, ["mask_id", "x"], "left").mapInPandas(flat, ", ".join(["mask_id long", *[f"{c} {meta.schema[c].dataType.simpleString()}" for c in known], "block int, x int, d binary"]))
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def whole(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values("x")
        d = np.stack([np.frombuffer(x, np.int32) for x in got["d"]]).reshape(nx, -1, nz).astype(np.int64)
        far = lambda v: envelope(np.where(v >= _FAR32, FAR, np.maximum(v, 0)))
        return pd.DataFrame({"mask_id": key[0], **body(int(key[1]), np.where(d < 0, -far(-d), far(d)), **{c: got[c].iloc[0] for c in known})})[["mask_id", *names]]

    return parts.groupBy("mask_id", "block").applyInPandas(whole, f"mask_id long, {schema}")


def distance_fields(meta: DataFrame, voxel: DataFrame, shape: tuple[int, int, int], cells: int = BLOCK, known: tuple[str, ...] = ()) -> DataFrame:
    """mask_id, x, y, z, d2 (long), and meta's known columns: the signed squared distance of every cell, outside to the mask, inside (negative) to its outside."""

    def body(y0: int, d2: np.ndarray, **row: object) -> dict:
        x, y, z = np.indices(d2.shape)
        return {"x": x.ravel(), "y": y.ravel() + y0, "z": z.ravel(), "d2": d2.ravel()} | {c: [v] * d2.size for c, v in row.items()}

    kinds = [f"{c} {meta.schema[c].dataType.simpleString()}" for c in known]
    return distance_blocks(meta, voxel, shape, body, ", ".join(["x int, y int, z int, d2 long", *kinds]), cells, known)


@lru_cache(32)
def cosines(n: int, order: int) -> np.ndarray:
    """The first `order` rows of the orthonormal DCT-II of length n."""
    k, at = np.arange(order)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * at + 1) * k / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))


def spectral_mask(order: int, radius: float) -> np.ndarray:
    i, j, k = np.indices((order, order, order))
    return i * i + j * j + k * k <= radius * radius


def dct_of(mask: np.ndarray, order: int, sphere: bool, saturation: float | None) -> np.ndarray:
    """The cosine coefficients of the signed distances below order (in a sphere), in C order."""
    v = signed_distances(mask)
    if saturation:
        v = saturation * np.tanh(v / saturation)
    a, b, c = (cosines(n, min(order, n)) for n in mask.shape)
    out = np.einsum("ix,jy,kz,xyz->ijk", a, b, c, v, optimize=True)
    return out[spectral_mask(order, order)[: len(a), : len(b), : len(c)]] if sphere else out.ravel()


def mask_of(coefficients: np.ndarray, shape: tuple[int, int, int], order: int, sphere: bool) -> np.ndarray:
    """Where the distances of the coefficients are below 0."""
    a, b, c = (cosines(n, min(order, n)) for n in shape)
    full = np.zeros((len(a), len(b), len(c)))
    keep = spectral_mask(order, order)[: len(a), : len(b), : len(c)] if sphere else np.ones(full.shape, bool)
    if keep.sum() != len(coefficients):
        raise ValueError(f"{keep.sum()} coefficients expected, {len(coefficients)} given")
    full[keep] = coefficients
    return np.einsum("ix,jy,kz,ijk->xyz", a, b, c, full, optimize=True) < 0


def dct_features(meta: DataFrame, voxel: DataFrame, shape: tuple[int, int, int], order: int = 16, sphere: bool = True, saturation: float | None = 5.0, cells: int = BLOCK) -> DataFrame:
    """mask_id, features: one array of coefficients a mask; null if it is empty or full, as there is no surface.

    Each block of distances gives its share of every coefficient; the shares are added up.
    """
    a, b, c = (cosines(n, min(order, n)) for n in shape)
    keep = spectral_mask(order, order)[: len(a), : len(b), : len(c)] if sphere else np.ones((len(a), len(b), len(c)), bool)

    def body(y0: int, d2: np.ndarray) -> dict:
        v = np.sign(d2) * np.sqrt(np.abs(d2).astype(np.float64))
        v = saturation * np.tanh(v / saturation) if saturation else v
        share = np.einsum("ix,jy,kz,xyz->ijk", a, b[:, y0 : y0 + d2.shape[1]], c, v, optimize=True)[keep]
        return {"share": [share.tolist() if abs(int(d2.flat[0])) < FAR else None]}

    shares = distance_blocks(meta, voxel, shape, body, "share array<double>", cells)
    sums = shares.select("mask_id", F.posexplode_outer("share").alias("at", "v")).groupBy("mask_id", "at").agg(F.sum("v").alias("v"))
    lists = sums.groupBy("mask_id").agg(F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "v")))).alias("c"))
    return lists.select("mask_id", F.when(F.size("c") > 0, F.col("c.v")).alias("features"))


def with_coefficients(rows: DataFrame, order: int, radius: Column | None = None) -> DataFrame:
    """rows with i, j, k and n, the place in a cube of `order`, of each cosine coefficient; those within the radius (order, if none) of each row."""
    for c in "ijk":
        rows = rows.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(order - 1))))
    most = F.lit(order) if radius is None else radius
    return rows.filter(F.expr("i*i + j*j + k*k") <= most * most).withColumn("n", F.expr(f"(i * {order} + j) * {order} + k"))


def long_features(features: DataFrame, order: int, sphere: bool = True) -> DataFrame:
    """mask_id, i, j, k, value for each coefficient."""
    keep = spectral_mask(order, order) if sphere else np.ones((order,) * 3, bool)
    named = F.array(*[F.struct(*[F.lit(int(v)).alias(c) for c, v in zip("ijk", x, strict=True)]) for x in np.argwhere(keep)])
    rows = features.select("mask_id", F.explode(F.arrays_zip(named.alias("at"), F.col("features").alias("value"))).alias("c"))
    return rows.select("mask_id", "c.at.*", "c.value")


def smoothed(meta: DataFrame, voxel: DataFrame, shape: tuple[int, int, int], order: int = 16, sphere: bool = True, saturation: float | None = 5.0) -> DataFrame:
    """The masks after a round trip through their first coefficients."""

    def body(_: int, mask: np.ndarray) -> Iterator[dict]:
        x, y, z = np.nonzero(mask_of(dct_of(mask, order, sphere, saturation), mask.shape, order, sphere))
        yield {"x": x, "y": y, "z": z}

    return per_mask(meta, voxel, shape, body, "mask_id long, x int, y int, z int")


def total_degree(order: int) -> np.ndarray:
    """Exponents i, j, k with i + j + k <= order, in lexicographic order; i belongs to the last axis."""
    return np.array([(i, j, k) for i in range(order + 1) for j in range(order + 1 - i) for k in range(order + 1 - i - j)])


def with_terms(rows: DataFrame, order: int) -> DataFrame:
    """rows with i, j, k and idx: the terms of a total-degree basis and their places."""
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(order))))
    rows = rows.withColumn("j", F.explode(F.expr(f"sequence(0, {order} - i)"))).withColumn("k", F.explode(F.expr(f"sequence(0, {order} - i - j)")))
    # Terms before (i, j, k): whole tetrahedra of smaller i, then whole triangles of smaller j, then k.
    left, rest = f"({order} - i)", f"({order} - i - j)"
    tetra = lambda n: f"(({n} + 1) * ({n} + 2) * ({n} + 3) div 6)"
    tri = lambda n: f"(({n} + 1) * ({n} + 2) div 2)"
    return rows.withColumn("idx", F.expr(f"cast({tetra(order)} - {tetra(left)} + {tri(left)} - {tri(rest)} + k as int)"))


def chebyshev_values(x: Column, order: int) -> Column:
    """The Chebyshev polynomials up to the order (1 at least) at x as an array, by the recurrence."""
    step = lambda a, n: F.array_append(a, 2.0 * x * F.get(a, n - 1) - F.get(a, n - 2))
    return F.aggregate(F.sequence(F.lit(2), F.lit(order)), F.array(F.lit(1.0), x), step) if order > 1 else F.array(F.lit(1.0), x)


def chebyshev(x: np.ndarray, order: int) -> np.ndarray:
    out = [np.ones_like(x), x]
    for _ in range(order - 1):
        out.append(2 * x * out[-1] - out[-2])
    return np.stack(out[: order + 1])


def _design(points: np.ndarray, order: int, cheby: bool) -> np.ndarray:
    power = [chebyshev(points[:, a], order) if cheby else points[:, a][None] ** np.arange(order + 1)[:, None] for a in (2, 1, 0)]
    i, j, k = total_degree(order).T
    return (power[0][i] * power[1][j] * power[2][k]).T


def polynomial_fit(mask: np.ndarray, order: int, cheby: bool, alpha: float, cells: int = 75_000, whole: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Ridge coefficients of the signed distances (scaled) at all cells, or so many evenly dealt ones; centre; scale.

    Monomials are fitted with an intercept. As a rule it is dropped, so their polynomial is 0 in the centre and below 0 in
    few cells, if any; whole puts it into the constant term.
    """
    n = np.array(mask.shape)
    sdf = signed_distances(mask)
    if cheby:
        centre, scale = n / 2, n.max() / 2
    else:
        at = np.argwhere(mask)
        centre, scale = (at.min(0) + at.max(0)) / 2, max(1.0, (at.max(0) - at.min(0)).max() / 2 * 1.1)
    points = np.argwhere(np.ones(mask.shape, bool))
    if len(points) > cells:
        points = points[:: -(-len(points) // cells)]
    unit = (points - centre) / scale
    ok = (np.abs(unit) <= 1).all(1)
    unit, y = unit[ok], sdf[tuple(points[ok].T)] / scale
    a = _design(unit, order, cheby)
    means, level = (np.zeros(a.shape[1]), 0.0) if cheby else (a.mean(0), y.mean())
    a, y = a - means, y - level
    c = np.linalg.solve(a.T @ a + alpha * np.eye(a.shape[1]), a.T @ y)
    if whole:
        c[0] += level - means @ c
    return c, centre, scale


def polynomial_mask(c: np.ndarray, shape: tuple[int, int, int], order: int, cheby: bool, centre: np.ndarray, scale: float) -> np.ndarray:
    points = np.argwhere(np.ones(shape, bool))
    unit = (points - centre) / scale
    ok = (np.abs(unit) <= 1).all(1)
    out = np.zeros(shape, bool)
    out[tuple(points[ok].T)] = _design(unit[ok], order, cheby) @ c < 0
    return out


def frames_of(meta: DataFrame, voxel: DataFrame, shape: tuple[int, int, int], cheby: bool) -> DataFrame:
    """mask_id, centre, scale of masks that aren't empty: for Chebyshev polynomials those of the grid, for monomials those of the mask's box."""
    box = voxel.groupBy("mask_id").agg(*[f(c).alias(f"{name}{c}") for c in "xyz" for f, name in ((F.min, "a"), (F.max, "b"))])
    if cheby:
        centre, scale = F.array(*[F.lit(n / 2) for n in shape]), F.lit(max(shape) / 2)
    else:
        centre = F.array(*[(F.col(f"a{c}") + F.col(f"b{c}")) / 2 for c in "xyz"])
        scale = F.greatest(F.lit(1.0), F.greatest(*[F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"]) / 2 * 1.1)
    return meta.select("mask_id").distinct().join(box, "mask_id").select("mask_id", centre.alias("centre"), scale.alias("scale"))


def normal_sums(rows: DataFrame, order: int, cheby: bool, held: int = 16) -> DataFrame:
    """mask_id, centre, scale, at, v: the sums of a least-squares fit over rows mask_id, x, y, z, d2, centre, scale, in one array by place.

    They are 1, y, the terms, the terms times y, and the products of the terms (row major). A task adds up what it reads,
    `held` masks at most at a time, so rows need not be sorted, sampled or brought together; then tasks' sums are added.
    """

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}

        def told(some: list[int]) -> pd.DataFrame:
            got = [(m, *sums.pop(m)) for m in some]
            return pd.DataFrame({"mask_id": [g[0] for g in got], "centre": [g[1] for g in got], "scale": [g[2] for g in got], "v": [g[3].tolist() for g in got]})

        for frame in frames:
            for mask_id, part in frame.groupby("mask_id", sort=False):
                centre, scale = part["centre"].iloc[0], float(part["scale"].iloc[0])
                unit = (part[["x", "y", "z"]].to_numpy() - np.asarray(centre)) / scale
                ok = (np.abs(unit) <= 1).all(1)
                d2 = part["d2"].to_numpy()[ok].astype(np.float64)
                y, a = np.sign(d2) * np.sqrt(np.abs(d2)) / scale, _design(unit[ok], order, cheby)
                new = np.concatenate([[len(y), y.sum()], a.sum(0), a.T @ y, (a.T @ a).ravel()])
                if mask_id in sums:
                    sums[mask_id][2] += new
                else:
                    sums[mask_id] = [list(centre), scale, new]
            if len(sums) > held:
                yield told(list(sums)[:-1])
        yield told(list(sums))

    parts = rows.mapInPandas(summed, "mask_id long, centre array<double>, scale double, v array<double>")
    each = parts.select("mask_id", "centre", "scale", F.posexplode("v").alias("at", "v"))
    return each.groupBy("mask_id", "centre", "scale", "at").agg(F.sum("v").alias("v"))


def solved(sums: DataFrame, order: int, cheby: bool, alpha: float, whole: bool = False) -> DataFrame:
    """mask_id, features, centre, scale: the ridge coefficients of normal_sums; the intercept of monomials as in polynomial_fit."""
    t = len(total_degree(order))

    def solve(got: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros(2 + 2 * t + t * t)
        v[got["at"]] = got["v"]
        n, level, means, ay, aa = max(v[0], 1.0), v[1], v[2 : 2 + t], v[2 + t : 2 + 2 * t], v[2 + 2 * t :].reshape(t, t)
        if cheby:
            c = np.linalg.solve(aa + alpha * np.eye(t), ay)
        else:
            means, level = means / n, level / n
            c = np.linalg.solve(aa - n * np.outer(means, means) + alpha * np.eye(t), ay - n * means * level)
            if whole:
                c[0] += level - means @ c
        return pd.DataFrame({"mask_id": got["mask_id"].iloc[:1], "features": [c.tolist()], "centre": [list(got["centre"].iloc[0])], "scale": got["scale"].iloc[:1]})

    return sums.groupBy("mask_id").applyInPandas(solve, "mask_id long, features array<double>, centre array<double>, scale double")


def polynomial_features(meta: DataFrame, voxel: DataFrame, shape: tuple[int, int, int], order: int, cheby: bool, alpha: float, whole: bool = False, samples: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """mask_id, features, centre, scale of masks that aren't empty, fitted to the signed distances of all cells.

    samples: what of the field (mask_id, x, y, z, d2, centre, scale) is fitted instead, such as inverse.band_samples.
    The normal equations are sums over cells, so no mask is whole in a task.
    """
    known = frames_of(meta, voxel, shape, cheby)
    field = distance_fields(known, voxel, shape, known=("centre", "scale"))
    return solved(normal_sums(samples(field) if samples else field, order, cheby), order, cheby, alpha, whole)
