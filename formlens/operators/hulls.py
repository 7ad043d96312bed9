"""Convex hulls of point sets: hulls of parts first, then the hull of their corners, so that no task holds all points of a mask."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import harmonics

#: Points of a part, about.
PART = 1 << 16


class _Face:
    __slots__ = ("beyond", "corners", "normal", "offset")

    def __init__(self, points: np.ndarray, corners: tuple[int, int, int]) -> None:
        a, b, c = points[list(corners)]
        normal = np.cross(b - a, c - a)
        self.corners, self.normal = corners, normal / max(np.linalg.norm(normal), 1e-300)
        self.offset = self.normal @ a
        self.beyond = np.zeros(0, int)

    def edges(self) -> list[tuple[int, int]]:
        i, j, k = self.corners
        return [(i, j), (j, k), (k, i)]


def _first(points: np.ndarray, near: float) -> list[int] | None:
    """Four points that span space; None if all are within `near` of a plane."""
    a = int(points[:, 0].argmin())
    d = points - points[a]
    b = int((d * d).sum(1).argmax())
    along = d[b] / max(np.linalg.norm(d[b]), 1e-300)
    off = d - np.outer(d @ along, along)
    c = int((off * off).sum(1).argmax())
    normal = np.cross(d[b], d[c])
    length = np.linalg.norm(normal)
    if length <= near * max(np.linalg.norm(d[b]), 1e-300):
        return None
    high = d @ (normal / length)
    e = int(np.abs(high).argmax())
    if abs(high[e]) <= near:
        return None
    return [a, b, c, e] if high[e] < 0 else [a, c, b, e]  # the first three are seen from outside


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the triangles of the hull, outward; none if the points lie in a plane.

    A face keeps the points beyond it. The farthest of one becomes a corner: the faces that it sees go, found from edge
    to edge, and their rim is joined to it.
    """
    points = np.asarray(points, float)
    if len(points) < 4:
        return np.zeros((0, 3), int)
    near = 1e-10 * max(np.abs(points - points.mean(0)).max(), 1e-300)
    first = _first(points, near)
    if first is None:
        return np.zeros((0, 3), int)
    a, b, c, d = first
    beside: dict[tuple[int, int], _Face] = {}
    todo: list[_Face] = []

    def add(faces: list[_Face], left: np.ndarray) -> None:
        for face in faces:
            for edge in face.edges():
                beside[edge] = face
            above = points[left] @ face.normal - face.offset > near
            face.beyond, left = left[above], left[~above]
            if len(face.beyond):
                todo.append(face)

    add([_Face(points, f) for f in ((a, b, c), (a, d, b), (b, d, c), (c, d, a))], np.setdiff1d(np.arange(len(points)), first))
    while todo:
        face = todo.pop()
        if beside.get(face.edges()[0]) is not face:
            continue  # gone by now
        p = int(face.beyond[(points[face.beyond] @ face.normal).argmax()])
        seen, front, rim = {id(face): face}, [face], []
        while front:
            for i, j in front.pop().edges():
                other = beside[j, i]
                if id(other) in seen:
                    continue
                if other.normal @ points[p] - other.offset > near:
                    seen[id(other)] = other
                    front.append(other)
                else:
                    rim.append((i, j))
        rim = [(i, j) for i, j in rim if id(beside[j, i]) not in seen]
        left = np.unique(np.concatenate([f.beyond for f in seen.values()]))
        for gone in seen.values():
            for edge in gone.edges():
                del beside[edge]
        add([_Face(points, (i, j, p)) for i, j in rim], left[left != p])
    return np.array([f.corners for f in {id(f): f for f in beside.values()}.values()]).reshape(-1, 3)


def convex_hulls(vertices: DataFrame, part: int = PART) -> DataFrame:
    """mask_id, fid, i, j, k: outward triangles over the vids of vertices (mask_id, vid, x, y, z); points in a plane have none.

    Of equal points the least vid stands for all.
    """
    rows = vertices.groupBy("mask_id", *[F.col(c).cast("double").alias(c) for c in "xyz"]).agg(F.min("vid").cast("long").alias("vid"))
    parts = rows.groupBy("mask_id").agg(F.ceil(F.count("*") / part).alias("parts"))
    rows = rows.join(parts, "mask_id").withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts")))

    def corners(got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values("vid")
        found = np.unique(hull(got[["x", "y", "z"]].to_numpy()))
        return got.iloc[found] if len(found) else got  # a flat part stays whole

    def faces(got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values("vid")
        vid = got["vid"].to_numpy()[hull(got[["x", "y", "z"]].to_numpy())]
        return pd.DataFrame({"mask_id": [got["mask_id"].iloc[0]] * len(vid), "fid": np.arange(len(vid)), "i": vid[:, 0], "j": vid[:, 1], "k": vid[:, 2]})

    left = rows.select("mask_id", "part", "vid", "x", "y", "z").groupBy("mask_id", "part").applyInPandas(corners, "mask_id long, part long, vid long, x double, y double, z double")
    return left.groupBy("mask_id").applyInPandas(faces, "mask_id long, fid long, i long, j long, k long")


def harmonic_surface(coefficients: DataFrame, lmax: int = 8) -> tuple[DataFrame, DataFrame]:
    """Vertices (mask_id, vid, x, y, z) of the radii that coefficients up to lmax give about 0, at the angles of a grid of 2 lmax + 3 each way, and the faces of their hull."""
    n = 2 * lmax + 3
    t, p = (a.ravel() for a in np.meshgrid(np.linspace(0, np.pi, n), np.linspace(0, 2 * np.pi, n), indexing="ij"))
    way = np.stack([np.sin(t) * np.cos(p), np.sin(t) * np.sin(p), np.cos(t)], 1)

    def places(got: pd.DataFrame) -> pd.DataFrame:
        radius = harmonics.real_harmonics(lmax, t, p)[:, (got["l"] * got["l"] + got["l"] + got["m"]).to_numpy()] @ got["c"].to_numpy()
        x = way * radius[:, None]
        return pd.DataFrame({"mask_id": got["mask_id"].iloc[0], "vid": np.arange(len(x)), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]})

    rows = coefficients.filter(F.col("l") <= lmax).select("mask_id", "l", "m", "c")
    vertices = rows.groupBy("mask_id").applyInPandas(places, "mask_id long, vid long, x double, y double, z double")
    return vertices, convex_hulls(vertices)
