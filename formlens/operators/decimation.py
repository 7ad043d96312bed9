"""Fewer vertices for a mesh, to a number: edges are drawn together in the order of the error that it makes."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .inverse import _mesh, _per_mesh

Point = tuple[float, float, float]


def _cross(u: Point, v: Point) -> Point:
    return u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]


def _minus(u: Point, v: Point) -> Point:
    return u[0] - v[0], u[1] - v[1], u[2] - v[2]


def _dot(u: Point, v: Point) -> float:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def _error(q: list[float], p: Point) -> float:
    """The sum of squared distances of p to the planes of q, weighted by area."""
    a, b, c, d, e, f, g, h, i, w = q
    x, y, z = p
    return max(0.0, x * (a * x + 2 * (b * y + c * z + g)) + y * (d * y + 2 * (e * z + h)) + z * (f * z + 2 * i) + w)


def _lowest(q: list[float]) -> Point | None:
    """Where the error is least; None where the planes don't fix it."""
    a, b, c, d, e, f, g, h, i, _ = q
    m = d * f - e * e, c * e - b * f, b * e - c * d
    det = a * m[0] + b * m[1] + c * m[2]
    if abs(det) < 1e-3 * (abs(a) + abs(d) + abs(f)) ** 3 / 27:
        return None
    n, o, p = a * f - c * c, b * c - a * e, a * d - b * b
    return -(m[0] * g + m[1] * h + m[2] * i) / det, -(m[1] * g + n * h + o * i) / det, -(m[2] * g + o * h + p * i) / det


def decimate(at: np.ndarray, corner: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vertices left (their old places, where they lie) and the faces, by old places.

    Edges are drawn together while there are more vertices than the target: the one first whose new vertex is the least off
    the planes of all faces that went into it. Not drawn together are edges by which the surface would touch itself or a
    face turn over, and vertices of open edges; so a closed surface stays closed and of its kind, and more vertices than
    asked for stay only if no edge is left.
    """
    place: list[Point] = [tuple(p) for p in at.tolist()]
    faces: list[tuple[int, int, int] | None] = [tuple(f) for f in corner.tolist()]
    around: list[set[int]] = [set() for _ in place]
    edges: dict[tuple[int, int], int] = {}
    for n, f in enumerate(faces):
        for u, v in zip(f, f[1:] + f[:1], strict=True):
            around[u].add(n)
            edges[min(u, v), max(u, v)] = edges.get((min(u, v), max(u, v)), 0) + 1
    fixed = {v for e, n in edges.items() if n != 2 for v in e}
    quadric = [[0.0] * 10 for _ in place]
    for f in faces:
        a, b, c = (place[v] for v in f)
        normal = _cross(_minus(b, a), _minus(c, a))
        area = _dot(normal, normal) ** 0.5
        if area:
            x, y, z = (t / area for t in normal)
            w = -_dot((x, y, z), a)
            plane = [area * t for t in (x * x, x * y, x * z, y * y, y * z, z * z, x * w, y * w, z * w, w * w)]
            for v in f:
                quadric[v] = [s + t for s, t in zip(quadric[v], plane, strict=True)]
    stamp = [0] * len(place)

    def candidate(u: int, v: int) -> tuple:
        q = [s + t for s, t in zip(quadric[u], quadric[v], strict=True)]
        a, b = place[u], place[v]
        ways = [tuple((s + t) / 2 for s, t in zip(a, b, strict=True)), a, b]
        length = _dot(_minus(a, b), _minus(a, b))
        if best := _lowest(q):
            off = _minus(best, ways[0])
            ways = [best, *ways] if _dot(off, off) <= 4 * length else ways
        error, turn = min((_error(q, p), n) for n, p in enumerate(ways))
        return error + 1e-9 * length * length, u, v, stamp[u], stamp[v], ways[turn]

    def ring(v: int) -> set[int]:
        return {u for n in around[v] for u in faces[n]} - {v}

    def turns(v: int, other: int, p: Point) -> bool:
        """Whether a face of v that stays would turn over, or nearly so, with v at p."""
        for n in around[v]:
            f = faces[n]
            if other not in f:
                k = f.index(v)
                b, c = place[f[k - 2]], place[f[k - 1]]
                old, new = _cross(_minus(b, place[v]), _minus(c, place[v])), _cross(_minus(b, p), _minus(c, p))
                if _dot(old, new) <= 0.1 * (_dot(old, old) * _dot(new, new)) ** 0.5 and _dot(old, old) > 0:
                    return True
        return False

    heap = [candidate(u, v) for u, v in edges if u not in fixed and v not in fixed]
    heapify(heap)
    left = len(place)
    while left > target and heap:
        _, u, v, su, sv, p = heappop(heap)
        if stamp[u] != su or stamp[v] != sv:
            continue
        ru, rv = ring(u), ring(v)
        if len(ru & rv) != 2 or len(ru | rv) < 5 or turns(u, v, p) or turns(v, u, p):
            continue
        for n in around[u] & around[v]:
            for w in faces[n]:
                if w not in (u, v):
                    around[w].discard(n)
            around[u].discard(n)
            faces[n] = None
        for n in around[v]:
            if faces[n]:
                faces[n] = tuple(u if w == v else w for w in faces[n])
                around[u].add(n)
        place[u], quadric[u] = p, [s + t for s, t in zip(quadric[u], quadric[v], strict=True)]
        around[v] = set()
        stamp[u], stamp[v], left = stamp[u] + 1, -1, left - 1
        for w in ring(u):
            if w not in fixed:
                heappush(heap, candidate(min(u, w), max(u, w)))
    kept = np.array([v for v in range(len(place)) if stamp[v] >= 0], int)
    rest = np.array([f for f in faces if f], int).reshape(-1, 3)
    return kept, np.array(place).reshape(-1, 3)[kept], rest


def decimated(vertices: DataFrame, faces: DataFrame, target: int) -> tuple[DataFrame, DataFrame]:
    """The meshes with `target` vertices, or all if they have fewer; see decimate. A vertex keeps a vid, faces are numbered anew.

    A mesh is drawn together in one task, as each step hangs on those before.
    """

    def points(v: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        vid, at, corner = _mesh(v, f)
        kept, place, _ = decimate(at, corner, target)
        return pd.DataFrame({"mask_id": v["mask_id"].iloc[0] if len(v) else 0, "vid": vid[kept], "x": place[:, 0], "y": place[:, 1], "z": place[:, 2]})

    def sides(v: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        vid, at, corner = _mesh(v, f)
        rest = vid[decimate(at, corner, target)[2]]
        return pd.DataFrame({"mask_id": v["mask_id"].iloc[0] if len(v) else 0, "fid": np.arange(len(rest)), "i": rest[:, 0], "j": rest[:, 1], "k": rest[:, 2]})

    return (
        _per_mesh(vertices, faces, points, "mask_id long, vid long, x double, y double, z double"),
        _per_mesh(vertices, faces, sides, "mask_id long, fid long, i long, j long, k long"),
    )
