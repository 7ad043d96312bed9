"""Triangle meshes as two tables: vertices (mask_id, vid, x, y, z) and faces (mask_id, fid, i, j, k)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sparse


def icosphere(subdivisions: int) -> tuple[np.ndarray, np.ndarray]:
    """Vertices on the unit sphere, 10 * 4**s + 2, and faces, 20 * 4**s."""
    g = (1 + 5**0.5) / 2
    v = [np.array(x, float) for a in (-1, 1) for b in (-g, g) for x in ((0, a, b), (a, b, 0), (b, 0, a))]
    v = [x / np.linalg.norm(x) for x in v]
    edge = min(np.linalg.norm(v[0] - x) for x in v[1:]) * 1.001
    near = [[np.linalg.norm(a - b) < edge for b in v] for a in v]
    faces = [(i, j, k) for i in range(12) for j in range(i) for k in range(j) if near[i][j] and near[j][k] and near[i][k]]
    faces = [(i, j, k) if np.linalg.det([v[i], v[j], v[k]]) > 0 else (i, k, j) for i, j, k in faces]
    for _ in range(subdivisions):
        middle: dict[tuple[int, int], int] = {}

        def between(a: int, b: int) -> int:
            key = (min(a, b), max(a, b))
            if key not in middle:
                x = v[a] + v[b]
                middle[key] = len(v)
                v.append(x / np.linalg.norm(x))
            return middle[key]

        split = []
        for i, j, k in faces:
            a, b, c = between(i, j), between(j, k), between(k, i)
            split += [(i, a, c), (j, b, a), (k, c, b), (a, b, c)]
        faces = split
    return np.array(v), np.array(faces)


def tetrahedra() -> list[list[tuple[int, int, int]]]:
    """The six tetrahedra about a unit cube's diagonal: one for each order in which the axes are gone along."""
    out = []
    for order in permutations(range(3)):
        corner, path = [0, 0, 0], [(0, 0, 0)]
        for axis in order:
            corner[axis] = 1
            path.append(tuple(corner))
        out.append(path)
    return out


@lru_cache(1)
def _triangles() -> list[np.ndarray]:
    """For each set of a cube's corners that are inside (bit 4x + 2y + z), the triangles between them and the others: [triangle, corner, axis] in half steps from the cube's first corner."""
    out = []
    for code in range(256):
        found = []
        for tet in tetrahedra():
            inside = [c for c in tet if code >> (4 * c[0] + 2 * c[1] + c[2]) & 1]
            outside = [c for c in tet if c not in inside]
            edge = lambda a, b: tuple(np.add(a, b))
            if len(inside) == 2:
                (a, b), (c, d) = inside, outside
                made = [(edge(a, c), edge(a, d), edge(b, d)), (edge(a, c), edge(b, d), edge(b, c))]
            elif inside and outside:
                one, rest = (inside[0], outside) if len(inside) == 1 else (outside[0], inside)
                made = [tuple(edge(one, x) for x in rest)]
            else:
                continue
            away = np.mean(outside, 0) - np.mean(inside, 0)
            for a, b, c in made:
                normal = np.cross(np.subtract(b, a), np.subtract(c, a))
                found.append((a, b, c) if normal @ away > 0 else (a, c, b))
        out.append(np.array(found, int).reshape(-1, 3, 3))
    return out


def surface_corners(voxel: DataFrame) -> DataFrame:
    """mask_id, fid, i, j, k (long) and the corners' coordinates ax, ay, az, bx, ...: the faces of surface_mesh, beside which no vertices are needed.

    A vertex's vid is made from its place and a face's fid from its cell, in the order of x, y, z, so they take neither a
    count nor a join; coordinates of voxels may lie between -2**18 and 2**18.
    """
    shift = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("ijk", (i, j, k), strict=True)]) for i in (0, 1) for j in (0, 1) for k in (0, 1)])).alias("s")
    cells = voxel.select("mask_id", "x", "y", "z", shift)
    bit = F.expr("shiftleft(1, 4 * s.i + 2 * s.j + s.k)")
    cells = cells.select("mask_id", *[(F.col(c) - F.col(f"s.{o}")).alias(c) for c, o in zip("xyz", "ijk", strict=True)], bit.alias("bit"))
    cells = cells.groupBy("mask_id", "x", "y", "z").agg(F.bit_or("bit").alias("code")).filter("code < 255")

    def number(at: np.ndarray, bits: int) -> np.ndarray:
        at = at.astype(np.int64) + (1 << (bits - 1))
        return (at[..., 0] << 2 * bits) + (at[..., 1] << bits) + at[..., 2]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _triangles()
        count = np.array([len(t) for t in table])
        start, flat = np.concatenate([[0], np.cumsum(count)[:-1]]), np.concatenate(table)
        for frame in frames:
            code, at = frame["code"].to_numpy(), frame[["x", "y", "z"]].to_numpy()
            n = count[code]
            row = np.repeat(np.arange(len(code)), n)
            within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            half = flat[start[code[row]] + within] + 2 * at[row][:, None, :]
            vid = number(half, 21)
            yield pd.DataFrame(
                {"mask_id": frame["mask_id"].to_numpy()[row], "fid": number(at[row], 19) * 16 + within}
                | {c: vid[:, n] for n, c in enumerate("ijk")}
                | {c + x: half[:, n, m] / 2 for n, c in enumerate("abc") for m, x in enumerate("xyz")})

    return cells.mapInPandas(cut, "mask_id long, fid long, i long, j long, k long, " + ", ".join(f"{c}{x} double" for c in "abc" for x in "xyz"))


def surface_mesh(voxel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of the masks' surfaces, by marching tetrahedra over the cells between voxels.

    A vertex is the middle between a set and an unset voxel of a tetrahedron, faces have their outside on the right hand
    side of their order, and each surface is closed, also where a mask touches the grid's border. Each cell is a row, so
    no mask has to be whole anywhere. Numbers are those of surface_corners: in order, but with gaps.
    """
    faces = surface_corners(voxel)
    each = F.explode(F.array(*[F.struct(F.col(n).alias("vid"), *[F.col(c + x).alias(x) for x in "xyz"]) for n, c in zip("ijk", "abc", strict=True)])).alias("v")
    vertices = faces.select("mask_id", each).select("mask_id", "v.*").dropDuplicates(["mask_id", "vid"])
    return vertices, faces.select("mask_id", "fid", "i", "j", "k")


def measures(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mask_id, volume (signed, by the divergence theorem), area, euler (vertices - edges + faces), open_edges (those of one face).

    Here and in inside_mesh, faces may be those of surface_corners, which need no join with vertices.
    """
    rows = faces if "ax" in faces.columns else _corners(vertices, faces)
    a, b, c = ([F.col(p + x) for x in "xyz"] for p in "abc")
    cross = lambda u, v: [u[(i + 1) % 3] * v[(i + 2) % 3] - u[(i + 2) % 3] * v[(i + 1) % 3] for i in range(3)]
    volume = sum(x * y for x, y in zip(a, cross(b, c), strict=True)) / 6
    normal = cross([y - x for x, y in zip(a, b, strict=True)], [y - x for x, y in zip(a, c, strict=True)])
    sums = rows.groupBy("mask_id").agg(F.sum(volume).alias("volume"), F.sum(F.sqrt(sum(x * x for x in normal)) / 2).alias("area"), F.count("*").alias("faces"))
    sides = F.explode(F.array(*[F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q")) for p, q in (("i", "j"), ("j", "k"), ("k", "i"))])).alias("e")
    edges = faces.select("mask_id", sides).groupBy("mask_id", "e").agg(F.count("*").alias("n"))
    edges = edges.groupBy("mask_id").agg(F.count("*").alias("edges"), F.count_if(F.col("n") == 1).alias("open_edges"))
    points = vertices.groupBy("mask_id").agg(F.count("*").alias("points"))
    return sums.join(edges, "mask_id").join(points, "mask_id").select("mask_id", "volume", "area", (F.col("points") - F.col("edges") + F.col("faces")).alias("euler"), "open_edges")


def inside_mesh(vertices: DataFrame, faces: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """mask_id, x, y, z of the cells inside each closed mesh: those above an odd number of faces, met by a ray along z.

    The ray is moved aside by a small amount, so it meets no edge of a mesh with vertices on half voxels.
    """
    off = (1e-3, 1.7e-3)
    rows = faces if "ax" in faces.columns else _corners(vertices, faces)
    least = {x: F.least(*[F.col(c + x) for c in "abc"]) for x in "xy"}
    most = {x: F.greatest(*[F.col(c + x) for c in "abc"]) for x in "xy"}
    for x, n, o in zip("xy", shape, off, strict=False):
        first, last = F.greatest(F.lit(0), F.ceil(least[x] - o)).cast("int"), F.least(F.lit(n - 1), F.floor(most[x] - o)).cast("int")
        rows = rows.withColumn(x, F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    px, py = F.col("x") + off[0], F.col("y") + off[1]
    area = lambda p, q: (F.col(q + "x") - F.col(p + "x")) * (py - F.col(p + "y")) - (F.col(q + "y") - F.col(p + "y")) * (px - F.col(p + "x"))
    w = [area("b", "c"), area("c", "a"), area("a", "b")]
    whole = w[0] + w[1] + w[2]
    meets = (whole != 0) & ((F.least(*w) > 0) | (F.greatest(*w) < 0))
    height = F.try_divide(w[0] * F.col("az") + w[1] * F.col("bz") + w[2] * F.col("cz"), whole)
    rows = rows.filter(meets).select("mask_id", "x", "y", F.greatest(F.lit(0), F.floor(height) + 1).cast("int").alias("z")).filter(F.col("z") < shape[2])
    # Cells from z on change sides; a cell is inside if the number of changes up to it is odd.
    turns = rows.groupBy("mask_id", "x", "y").agg(F.sort_array(F.collect_list("z")).alias("turns"))
    cells = F.filter(F.sequence(F.lit(0), F.lit(shape[2] - 1)), lambda z: F.size(F.filter("turns", lambda t: t <= z)) % 2 == 1)
    return turns.select("mask_id", "x", "y", F.explode(cells).alias("z"))


def _corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with their corners' coordinates: ax, ay, az, bx, ..."""
    for corner, c in zip("ijk", "abc", strict=True):
        v = vertices.select("mask_id", F.col("vid").alias(corner), *[F.col(x).alias(c + x) for x in "xyz"])
        faces = faces.join(v, ["mask_id", corner])
    return faces


def cotangent_laplacian(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mask_id, i, j, w: half the sum of the cotangents across each edge, negative, and on the diagonal the sum of a row's."""
    rows = _corners(vertices, faces)

    def cotangent(a: str, b: str, c: str) -> F.Column:
        u = [F.col(b + x) - F.col(a + x) for x in "xyz"]
        v = [F.col(c + x) - F.col(a + x) for x in "xyz"]
        cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
        return (u[0] * v[0] + u[1] * v[1] + u[2] * v[2]) / (F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]) + 1e-10)

    sides = [(("j", "k"), cotangent("a", "b", "c")), (("k", "i"), cotangent("b", "c", "a")), (("i", "j"), cotangent("c", "a", "b"))]
    entries = F.array(*[F.struct(F.col(p).alias("p"), F.col(q).alias("q"), (w / 2).alias("w")) for (a, b), w in sides for p, q in ((a, b), (b, a))])
    w = rows.select("mask_id", F.explode(entries).alias("e")).select("mask_id", F.col("e.p").alias("i"), F.col("e.q").alias("j"), F.col("e.w").alias("w"))
    w = w.groupBy("mask_id", "i", "j").agg(F.sum("w").alias("w"))
    diagonal = w.groupBy("mask_id", "i").agg(F.sum("w").alias("w")).select("mask_id", "i", F.col("i").alias("j"), "w")
    return w.select("mask_id", "i", "j", (-F.col("w")).alias("w")).unionByName(diagonal)


def laplacian_rows(got: pd.DataFrame) -> tuple[np.ndarray, sparse.Rows]:
    """The vids of a mesh's Laplacian (i, j, w), in order, and its rows."""
    ids, back = np.unique(np.concatenate([got["i"], got["j"]]), return_inverse=True)
    return ids, sparse.Rows(len(ids), back[: len(got)], back[len(got) :], got["w"].to_numpy())


def spectrum(laplacian: DataFrame, k: int) -> DataFrame:
    """mask_id, eigenvalues (the k smallest), modes (k arrays over the vertices in order of vid), by a sparse solve a mesh."""
    def solve(got: pd.DataFrame) -> pd.DataFrame:
        values, vectors = sparse.smallest(laplacian_rows(got)[1], k)
        return pd.DataFrame({"mask_id": got["mask_id"].iloc[:1], "eigenvalues": [values.tolist()], "modes": [vectors.T.tolist()]})

    return laplacian.groupBy("mask_id").applyInPandas(solve, "mask_id long, eigenvalues array<double>, modes array<array<double>>")


def top_modes(coefficients: DataFrame, percent: float) -> DataFrame:
    """Of mask_id, k, cx, cy, cz the max(1, ceil(percent of the modes)) of the largest norms, ties to the smaller k."""
    norm = F.expr("cx * cx + cy * cy + cz * cz")
    of = Window.partitionBy("mask_id")
    rows = coefficients.withColumn("_rank", F.row_number().over(of.orderBy(F.desc(norm), "k"))).withColumn("_all", F.count("*").over(of))
    return rows.filter(F.col("_rank") <= F.greatest(F.lit(1), F.ceil(F.col("_all") * percent / 100))).drop("_rank", "_all")


def inflation_step(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Each vertex halfway to the mean centre of its faces, then about the mean vertex and on the unit sphere."""
    rows = _corners(vertices, faces)
    centres = rows.select("mask_id", F.explode(F.array("i", "j", "k")).alias("vid"), *[((F.col("a" + x) + F.col("b" + x) + F.col("c" + x)) / 3).alias("f" + x) for x in "xyz"])
    centres = centres.groupBy("mask_id", "vid").agg(*[F.avg("f" + x).alias("f" + x) for x in "xyz"])
    moved = vertices.join(centres, ["mask_id", "vid"], "left").select("mask_id", "vid", *[(0.5 * F.col(x) + 0.5 * F.coalesce("f" + x, x)).alias(x) for x in "xyz"])
    mean = moved.groupBy("mask_id").agg(*[F.avg(x).alias("m" + x) for x in "xyz"])
    moved = moved.join(mean, "mask_id").select("mask_id", "vid", *[(F.col(x) - F.col("m" + x)).alias(x) for x in "xyz"])
    norm = F.sqrt(F.expr("x * x + y * y + z * z")) + 1e-9
    return moved.select("mask_id", "vid", *[(F.col(x) / norm).alias(x) for x in "xyz"])
