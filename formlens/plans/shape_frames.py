"""More queries of the catalogue: masks in other frames, expansions by quadrature, hulls, components on tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chains, copies, harmonics, hulls, masks, resample, wide_pca
from ..sources import cohorts
from .catalogue import _MANY, SHAPE, query, r, rounded, vectors
from .shape_inverse import _radii

#: A frame for each mask: voxels of unequal size, turned by a triangle of sides 3, 4, 5.
_FRAMES = f"""{_MANY}, fr AS (SELECT mask_id, 1e0 AS sx, 1.25e0 + (mask_id % 2) * 0.25e0 AS sy, 0.75e0 AS sz, 1 + (mask_id % 3) * 0.25e0 AS k FROM par),
g AS (SELECT mask_id, ox, oy, oz, (0.6e0 * u - 0.8e0 * v + 7 * sx) / sx AS ax, (0.8e0 * u + 0.6e0 * v + 8 * sy) / sy AS ay, (w + 7 * sz) / sz AS az
  FROM (SELECT fr.*, ox, oy, oz, (ox - 8.5e0) / k AS u, (oy - 8.5e0) / k AS v, (oz - 8.5e0) / k AS w FROM fr, range(18) a(ox), range(18) b(oy), range(18) c(oz))),
n AS (SELECT mask_id, ox, oy, oz, floor(ax)::INT + i AS x, floor(ay)::INT + j AS y, floor(az)::INT + m AS z,
  abs(1 - i - (ax - floor(ax))) * abs(1 - j - (ay - floor(ay))) * abs(1 - m - (az - floor(az))) AS w FROM g, range(2) p(i), range(2) q(j), range(2) s(m))
SELECT mask_id, ox::INT AS x, oy::INT AS y, oz::INT AS z, {r('sum(w)')} AS value FROM n JOIN voxel USING (mask_id, x, y, z) GROUP BY ALL HAVING sum(w) > 0.3e0 + 1e-9"""


@query(_FRAMES)
def resampled_values(spark, sf_dir):
    """Trilinear values of masks with their own voxel sizes on a turned grid."""
    meta, voxel = cohorts.masks(spark, sf_dir, "supplier")
    axes = F.array(*[F.array(*[F.lit(x) for x in v]) for v in ((0.6, 0.8, 0.0), (-0.8, 0.6, 0.0), (0.0, 0.0, 1.0))])
    size = F.array(F.lit(1.0), 1.25 + F.col("mask_id") % 2 * 0.25, F.lit(0.75))
    frames = meta.select("mask_id", size.alias("spacing"), axes.alias("axes"), (1 + F.col("mask_id") % 3 * 0.25).alias("scale"))
    frames = frames.withColumn("centre", F.zip_with("spacing", F.array(*[F.lit(x) for x in (7.0, 8.0, 7.0)]), lambda a, b: a * b))
    return rounded(copies.once(voxel, lambda own: resample.resampled(own, frames, 18, level=0.3), frames), 6, "value")


@query()
def normalized_cohort(spark, sf_dir):
    """Masks in their canonical frames with the same volume, from voxels of unequal size; tested against dense code and on one shape in two voxel sizes."""
    meta, voxel = cohorts.masks(spark, sf_dir, "supplier")
    size = meta.select("mask_id", (1 + F.col("mask_id") % 3 * 0.25).alias("dz"))
    return copies.once(masks.flip_left(meta, voxel, SHAPE[0]), lambda own: resample.normalised(own, size, 25, 400.0), size)


@query(f"""{_MANY}, a AS (SELECT angle, round(cos(radians(angle)), 15) AS co, round(sin(radians(angle)), 15) AS si FROM range(0, 360, 45) h(angle)),
ref AS (SELECT x, y, z FROM voxel WHERE mask_id = (SELECT min(mask_id) FROM par)),
t AS (SELECT par.mask_id, angle, ox, oy, floor(co * (ox - 7.5e0) + si * (oy - 7.5e0) + 7.5e0 + 0.5e0)::INT AS x, floor(-si * (ox - 7.5e0) + co * (oy - 7.5e0) + 7.5e0 + 0.5e0)::INT AS y
  FROM par, a, range(16) g(ox), range(16) h(oy)),
n AS (SELECT mask_id, angle, ox, oy, z FROM t JOIN voxel USING (mask_id, x, y)),
d AS (SELECT mask_id, angle, 2e0 * count(ref.x) / (count(*) + (SELECT count(*) FROM ref)) AS dice FROM n LEFT JOIN ref ON ref.x = ox AND ref.y = oy AND ref.z = n.z GROUP BY mask_id, angle)
SELECT mask_id, arg_min(angle, (-dice, angle))::DOUBLE AS angle, max(dice) AS dice FROM d GROUP BY mask_id""")
def reference_turns(spark, sf_dir):
    """The turn, in steps of 45 degrees, at which each mask meets the first one best."""
    meta, voxel = cohorts.masks(spark, sf_dir, "supplier")
    first = voxel.join(meta.agg(F.min("mask_id").alias("mask_id")), "mask_id")
    return copies.once(voxel, lambda own: resample.best_turns(own, first, SHAPE, step=45))


#: Real harmonics up to degree 3 of a unit vector: root of the factor over pi, and the polynomial.
_HARMONICS = {
    (0, 0): ("0.25e0", "1"),
    (1, -1): ("0.75e0", "y"), (1, 0): ("0.75e0", "z"), (1, 1): ("0.75e0", "x"),
    (2, -2): ("3.75e0", "x*y"), (2, -1): ("3.75e0", "y*z"), (2, 0): ("0.3125e0", "(3*z*z-1)"), (2, 1): ("3.75e0", "x*z"), (2, 2): ("0.9375e0", "(x*x-y*y)"),
    (3, -3): ("1.09375e0", "y*(3*x*x-y*y)"), (3, -2): ("26.25e0", "x*y*z"), (3, -1): ("0.65625e0", "y*(5*z*z-1)"), (3, 0): ("0.4375e0", "z*(5*z*z-3)"),
    (3, 1): ("0.65625e0", "x*(5*z*z-1)"), (3, 2): ("6.5625e0", "z*(x*x-y*y)"), (3, 3): ("1.09375e0", "x*(x*x-3*y*y)"),
}
_EXPANSION = f"""{_radii('supplier')}, w AS (SELECT t, any_value(4 / 64e0 * sin(pi() * t / 64)) * sum(sin((2 * k + 1) * pi() * t / 64) / (2 * k + 1)) AS w FROM range(64) a(t), range(32) b(k) GROUP BY t),
q AS (SELECT mask_id, r / (greatest(2, side) / 2e0) * w * 2 * pi() / 128 AS f, sin(pi() * t / 64) * cos(2 * pi() * p / 128) AS x, sin(pi() * t / 64) * sin(2 * pi() * p / 128) AS y, cos(pi() * t / 64) AS z FROM g JOIN w USING (t)),
c AS (SELECT mask_id, [{', '.join(f'sqrt({a} / pi()) * sum(f * {b})' for a, b in _HARMONICS.values())}] AS c FROM q GROUP BY mask_id),
names AS (SELECT * FROM (VALUES {', '.join(f'({i}, {n}, {m})' for i, (n, m) in enumerate(_HARMONICS, 1))}) v(i, l, m))
SELECT mask_id, l::INT AS l, m::INT AS m, {r('c[i]')} AS c FROM c, names"""


@query(_EXPANSION)
def sh_expansion_values(spark, sf_dir):
    """Coefficients of degrees 0 to 3 of the radius maps, by quadrature."""
    found = copies.once(cohorts.masks(spark, sf_dir, "supplier")[1], lambda own: harmonics.expanded_coefficients(own, 3))
    return rounded(found.select("mask_id", "l", "m", "c"), 6, "c")


@query()
def harmonic_diagnostics(spark, sf_dir):
    """Dice and surface distances of the masks with their round trips through harmonics; tested on a ball and against the parts."""
    meta, voxel = cohorts.masks(spark, sf_dir, "supplier")
    return chains.harmonic_diagnostics(meta, voxel, SHAPE, 8, fitted=True)


@query(f"""{_MANY} SELECT mask_id, i::INT AS i, j::INT AS j, k::INT AS k, max(i * x + j * y + k * z)::DOUBLE AS reach
FROM voxel, range(-2, 3) a(i), range(-2, 3) b(j), range(-2, 3) c(k) GROUP BY ALL""")
def hull_reach(spark, sf_dir):
    """How far the corners of each mask's hull reach in 125 directions, which is as far as its voxels do."""
    return copies.once(cohorts.masks(spark, sf_dir, "supplier")[1], _reach)


def _reach(voxel):
    points = voxel.select("mask_id", ((F.col("x") * SHAPE[1] + F.col("y")) * SHAPE[2] + F.col("z")).cast("long").alias("vid"), "x", "y", "z")
    corners = hulls.convex_hulls(points).select("mask_id", F.explode(F.array("i", "j", "k")).alias("vid")).distinct()
    way = lambda c: F.explode(F.sequence(F.lit(-2), F.lit(2))).alias(c)
    ways = points.join(corners, ["mask_id", "vid"]).select("*", way("i")).select("*", way("j")).select("*", way("k"))
    return ways.groupBy("mask_id", "i", "j", "k").agg(F.max(F.expr("i * x + j * y + k * z")).cast("double").alias("reach"))


@query()
def hull_surface(spark, sf_dir):
    """Faces of the hulls of the surfaces that harmonics give."""
    return copies.once(cohorts.masks(spark, sf_dir, "supplier")[1], lambda own: hulls.harmonic_surface(harmonics.expanded_coefficients(own, 8))[1])


@query()
def tiled_pca_variances(spark, sf_dir):
    """Leading variances of the embeddings by conjugate gradients on tiles, until residuals are 0.0001 of the first, so errors are far smaller; tested against a dense decomposition."""
    model = wide_pca.fit(vectors(spark, sf_dir), 4, tolerance=1e-4, rows=2048)
    return model.table().select("k", "variance", "variance_ratio")
