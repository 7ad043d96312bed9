"""Small linear algebra as Spark expressions: dot products, 4x4 affines, eigenvalues of symmetric 3x3 matrices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def affine_product(a: Column, b: Column) -> Column:
    """The product of two 4x4 matrices, each an array of rows."""
    column = lambda j: F.transform(b, lambda r: r[j])
    return F.transform(a, lambda row: F.array(*[dot(row, column(j)) for j in range(4)]))


def into_axes(axes: Column, centroid: Column) -> Column:
    """The affine from world coordinates to those about centroid along axes (an array of unit vectors)."""
    rows = F.transform(axes, lambda v: F.concat(v, F.array(-dot(v, centroid))))
    return F.concat(rows, F.array(F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])))


def eigenvalues(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> list[Column]:
    """Those of a symmetric 3x3 matrix, largest first, by the trigonometric closed form."""
    q = (xx + yy + zz) / 3.0
    a, b, c = xx - q, yy - q, zz - q
    p = F.sqrt((a * a + b * b + c * c + 2.0 * (xy * xy + xz * xz + yz * yz)) / 6.0)
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    half = det / (2.0 * F.greatest(p, F.lit(1e-9)) * F.greatest(p, F.lit(1e-9)) * F.greatest(p, F.lit(1e-9)))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3.0
    round_ = p < 1e-9
    first = F.when(round_, q).otherwise(q + 2.0 * p * F.cos(angle))
    last = F.when(round_, q).otherwise(q + 2.0 * p * F.cos(angle + F.lit(2.0943951023931953)))
    return [first, 3.0 * q - first - last, last]
