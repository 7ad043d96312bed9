"""More queries of the catalogue: shapes from coefficients, inflated meshes, point distributions and samples, with the values in closed form."""

from __future__ import annotations

import numpy as np
from numpy.polynomial import chebyshev
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import harmonics, inverse, meshes, transforms
from ..sources import cohorts
from .catalogue import _EDT, SHAPE, query, r, rounded

_KEY = "s_suppkey::BIGINT AS mask_id"


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("mask_id"))


# Polynomials below 0 in one of two balls: about 0.3 and -0.6 on the first axis, of radius 0.21 + 0.02 v, as v = key % 5.


def _two_balls(spark: SparkSession, sf_dir: str, cheby: bool) -> DataFrame:
    tensors = []
    for v in range(5):
        balls = []
        for at in (0.3, -0.6):
            ball = np.zeros((5, 5, 5))  # exponents of x, y, z
            ball[2, 0, 0] = ball[0, 2, 0] = ball[0, 0, 2] = 1
            ball[1, 0, 0], ball[0, 0, 0] = -2 * at, at * at - (0.21 + 0.02 * v) ** 2
            balls.append(ball)
        both = np.zeros((5, 5, 5))
        for p, q in ((p, q) for p in np.argwhere(balls[0]) for q in np.argwhere(balls[1])):
            both[tuple(p + q)] += balls[0][tuple(p)] * balls[1][tuple(q)]
        if cheby:
            for axis in range(3):
                both = np.apply_along_axis(lambda c: np.pad(got := chebyshev.poly2cheb(c), (0, 5 - len(got))), axis, both)
        i, j, k = transforms.total_degree(4).T
        tensors.append((v, both[k, j, i].tolist()))
    known = F.broadcast(spark.createDataFrame(tensors, "v long, features array<double>"))  # five rows
    rows = _keys(spark, sf_dir).withColumn("v", F.expr("mask_id % 5")).join(known, "v")
    return rows.select("mask_id", "features", F.array(*[F.lit(x) for x in (7.5, 8.0, 7.0)]).alias("centre"), F.lit(6.0).alias("scale"))


def _balls_sql(cx: float, cy: float, cz: float, scale: float, where: str) -> str:
    ball = lambda at: f"pow(x - ({cx} + {at} * {scale}e0), 2) + pow(y - {cy}, 2) + pow(z - {cz}, 2) < pow({scale} * (0.21e0 + 0.02e0 * (mask_id % 5)), 2)"
    cells = f"(SELECT {_KEY}, gx.x::INT AS x, gy.y::INT AS y, gz.z::INT AS z FROM supplier, range(16) gx(x), range(16) gy(y), range(16) gz(z))"
    return f"SELECT mask_id, x, y, z FROM {cells} WHERE " + where.format(near=ball(0.3), far=ball(-0.6))


@query(_balls_sql(7.5, 8, 7, 6, "({near}) OR ({far})"))
def mono_voxels(spark, sf_dir):
    return inverse.polynomial_voxels(_two_balls(spark, sf_dir, False), SHAPE, 4, False)


@query(_balls_sql(8, 8, 8, 8, "{near}"))
def cheby_voxels(spark, sf_dir):
    """Only the ball that is nearer to the middle stays."""
    return inverse.chebyshev_voxels(_two_balls(spark, sf_dir, True), SHAPE, 4)


@query()
def mono_smooth_mask(spark, sf_dir):
    return inverse.smooth_polynomials(*cohorts.masks(spark, sf_dir, "nation"), SHAPE, 6, False, 1e-4, whole=True)


@query()
def cheby_smooth_mask(spark, sf_dir):
    return inverse.smooth_polynomials(*cohorts.masks(spark, sf_dir, "nation"), SHAPE, 8, True, 1e-3)


# Radii of degree 2 and volumes of five moments, from the key.
_CELLS = f"""c AS (SELECT {_KEY}, gx.x::INT AS x, gy.y::INT AS y, gz.z::INT AS z, (gx.x - 7.5e0) / 8 AS u, (gy.y - 8e0) / 8 AS v, (gz.z - 7.5e0) / 8 AS w
  FROM supplier, range(16) gx(x), range(16) gy(y), range(16) gz(z)),
s AS (SELECT *, sqrt(u * u + v * v + w * w) AS len, atan2(v, u) AS p FROM c), a AS (SELECT *, w / (len + 1e-9) AS ct FROM s)"""


def _coefficients(spark: SparkSession, sf_dir: str, names: tuple[str, ...], rows: tuple[tuple[str, ...], ...]) -> DataFrame:
    each = F.array(*[F.struct(*[F.expr(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows])[F.col("at")].alias("c")
    size = [F.array(*[F.lit(x) for x in (7.5, 8.0, 7.5)]).alias("centroid"), F.lit(8.0).alias("extent")]
    return cohorts.each(cohorts.dealt(_keys(spark, sf_dir)), "at", len(rows)).select("mask_id", each).select("mask_id", "c.*", *size)


@query(f"""WITH {_CELLS}, g AS (SELECT *, floor(acos(ct) / pi() * 6) * pi() / 6 AS tt, floor((CASE WHEN p < 0 THEN p + 2 * pi() ELSE p END) / (2 * pi()) * 6) * pi() / 3 AS pp FROM a)
SELECT mask_id, x, y, z FROM g WHERE len <= (1.6e0 + 0.1e0 * (mask_id % 7)) * sqrt(1 / (4 * pi())) + 0.1e0 * (mask_id % 3) * sqrt(3 / (4 * pi())) * sin(tt) * cos(pp)
  - 0.15e0 * sqrt(5 / (16 * pi())) * (3 * cos(tt) * cos(tt) - 1) + 0.12e0 * sqrt(15 / (16 * pi())) * sin(tt) * sin(tt) * sin(2 * pp)""")
def sh_volume(spark, sf_dir):
    """The coefficient of degree 3 is beyond lmax."""
    rows = (("0", "0", "1.6D + 0.1D * (mask_id % 7)"), ("1", "1", "0.1D * (mask_id % 3)"), ("2", "0", "-0.15D"), ("2", "-2", "0.12D"), ("3", "1", "9D"))
    return inverse.harmonic_voxels(_coefficients(spark, sf_dir, ("l", "m", "c"), rows), SHAPE, lmax=2)


_VALUE = """sqrt(1 / (4 * pi())) * (1 + mask_id % 5 + 0.5e0 * (2 * len * len - 1)) - 2 * sqrt(3 / (8 * pi())) * len * sqrt(1 - ct * ct) * (cos(p) - 0.25e0 * (mask_id % 3) * sin(p))
  + 0.7e0 * sqrt(5 / (16 * pi())) * len * len * (3 * ct * ct - 1)"""


@query(f"WITH {_CELLS} SELECT mask_id, x, y, z, {r(_VALUE)} AS value FROM a")
def zernike_volume(spark, sf_dir):
    """Moments (n, m, l): (0, 0, 0), (2, 0, 0), a pair (1, 1, 1) and (1, -1, 1) and (2, 0, 2)."""
    rows = (("0", "0", "0", "1D + mask_id % 5", "0D"), ("2", "0", "0", "0.5D", "3D"), ("1", "1", "1", "1D", "0.25D * (mask_id % 3)"),
            ("1", "-1", "1", "-1D", "0.25D * (mask_id % 3)"), ("2", "0", "2", "0.7D", "0D"))
    moments = _coefficients(spark, sf_dir, ("n", "m", "l", "re", "im"), rows)
    sizes = moments.select("mask_id", "centroid", F.col("extent").alias("most")).distinct()
    return rounded(inverse.zernike_field(moments.drop("extent", "centroid"), sizes, SHAPE), 6, "value")


# Octahedra with half axes from the key; they inflate to the unit axes.
_AXES = "(SELECT s_suppkey::BIGINT AS mask_id, (1 + s_suppkey % 5)::DOUBLE AS a, (2 + s_suppkey % 3)::DOUBLE AS b, (1 + s_suppkey % 7)::DOUBLE AS c FROM supplier)"


def _octahedra(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    length = {"x": "1D + mask_id % 5", "y": "2D + mask_id % 3", "z": "1D + mask_id % 7"}
    ends = [(2 * n + (s < 0), {c: f"{s} * ({length[c]})" if c == axis else "0D" for c in "xyz"}) for n, axis in enumerate("xyz") for s in (1, -1)]
    points = F.array(*[F.struct(F.lit(v).cast("long").alias("vid"), *[F.expr(e).alias(c) for c, e in at.items()]) for v, at in ends])
    sides = [(x, y, z) if (x + y + z) % 2 == 0 else (x, z, y) for x in (0, 1) for y in (2, 3) for z in (4, 5)]
    faces = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(("fid", "i", "j", "k"), (n, *t), strict=True)]) for n, t in enumerate(sides)])
    keys = cohorts.dealt(_keys(spark, sf_dir))
    return tuple(cohorts.each(keys, "at", n).select("mask_id", e[F.col("at")].alias("e")).select("mask_id", "e.*") for e, n in ((points, len(ends)), (faces, len(sides))))


@query(f"""SELECT mask_id, (2 * axis + h)::BIGINT AS vid, CASE WHEN axis = 0 THEN 1e0 - 2 * h ELSE 0e0 END AS x, CASE WHEN axis = 1 THEN 1e0 - 2 * h ELSE 0e0 END AS y,
CASE WHEN axis = 2 THEN 1e0 - 2 * h ELSE 0e0 END AS z, {r('CASE axis WHEN 2 THEN h * pi() ELSE pi() / 2 END')} AS polar FROM {_AXES}, range(3) g(axis), range(2) gh(h)""")
def mesh_inflate(spark, sf_dir):
    return rounded(inverse.inflated(*_octahedra(spark, sf_dir)).drop("azimuth"), 6, "x", "y", "z", "polar")


def _ways() -> str:
    return ", ".join(f"({n}, {x:.17e}, {y:.17e}, {z:.17e})" for n, (x, y, z) in enumerate(meshes.icosphere(1)[0].tolist()))


@query(f"""WITH way(vid, x, y, z) AS (VALUES {_ways()}) SELECT mask_id, vid::BIGINT AS vid, {r('a * x / (abs(x) + abs(y) + abs(z))')} AS x, {r('b * y / (abs(x) + abs(y) + abs(z))')} AS y,
{r('c * z / (abs(x) + abs(y) + abs(z))')} AS z FROM {_AXES}, way""")
def pdm_features(spark, sf_dir):
    """A direction meets an octahedron where the absolute coordinates, in half axes, add to 1."""
    return rounded(inverse.point_distribution(*_octahedra(spark, sf_dir), subdivisions=1), 6, "x", "y", "z")


@query()
def pdm_voxels(spark, sf_dir):
    return inverse.point_voxels(inverse.point_distribution(*_octahedra(spark, sf_dir), subdivisions=2), SHAPE, subdivisions=2, samples=5000)


# Vertices whose coordinates are sums of harmonics


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cohorts.each(cohorts.each(cohorts.dealt(_keys(spark, sf_dir)), "t", 7), "p", 9)
    rows = rows.select("mask_id", F.expr("(t + 0.5D) * pi() / 7").alias("polar"), F.expr("p * 2 * pi() / 9").alias("azimuth"))
    x, y, z = "(1 + mask_id % 4) * sin(polar) * cos(azimuth)", "(2 + mask_id % 3) * sin(polar) * sin(azimuth)", "3 * cos(polar) + mask_id % 5"
    return rows.select("*", F.expr(x).alias("x"), F.expr(y).alias("y"), F.expr(z).alias("z"))


@query(f"""SELECT {_KEY}, l::INT AS l, m::INT AS m, {r('CASE WHEN l = 1 AND m = 1 THEN (1 + s_suppkey % 4) * sqrt(4 * pi() / 3) ELSE 0 END')} AS cx,
{r('CASE WHEN l = 1 AND m = -1 THEN (2 + s_suppkey % 3) * sqrt(4 * pi() / 3) ELSE 0 END')} AS cy,
{r('CASE WHEN l = 0 THEN (s_suppkey % 5) * sqrt(4 * pi()) WHEN l = 1 AND m = 0 THEN 3 * sqrt(4 * pi() / 3) ELSE 0 END')} AS cz FROM supplier, range(4) gl(l), range(-3, 4) gm(m) WHERE abs(m) <= l""")
def vector_harmonics(spark, sf_dir):
    return rounded(inverse.vector_harmonics(_mapped(spark, sf_dir), 3), 6, "cx", "cy", "cz")


@query(f"""WITH a AS (SELECT {_KEY}, t::INT AS t, p::INT AS p, t * pi() / 11 AS th, p * 2 * pi() / 23 AS ph FROM supplier, range(12) gt(t), range(24) gp(p))
SELECT mask_id, t, p, {r('(1 + mask_id % 4) * sin(th) * cos(ph)')} AS x, {r('(2 + mask_id % 3) * sin(th) * sin(ph)')} AS y, {r('3 * cos(th) + mask_id % 5')} AS z FROM a""")
def vector_surface(spark, sf_dir):
    return rounded(inverse.vector_points(inverse.vector_harmonics(_mapped(spark, sf_dir), 3), 3), 6, "x", "y", "z")


# Samples of cells


def _uniform(seed: int) -> str:
    return f"('0x' || substr(md5({seed} || ':' || mask_id || ':' || draw), 1, 8))::BIGINT / 4294967296e0"


_WINDOW = f"""{cohorts.oracle_cte('nation')}, cell AS (SELECT par.mask_id, gx.x::INT AS x, gy.y::INT AS y, gz.z::INT AS z, v.x IS NOT NULL AS own FROM par, range(16) gx(x), range(16) gy(y), range(16) gz(z)
  LEFT JOIN voxel v ON v.mask_id = par.mask_id AND v.x = gx.x AND v.y = gy.y AND v.z = gz.z),
o AS (SELECT i, j, k, i * i + j * j + k * k AS d FROM range(-2, 3) gi(i), range(-2, 3) gj(j), range(-2, 3) gk(k) WHERE i * i + j * j + k * k <= 4),
n AS (SELECT mask_id, x + i AS x, y + j AS y, z + k AS z, own, d FROM cell, o),
w AS (SELECT a.mask_id, a.x, a.y, a.z, a.own, min(n.d) FILTER (WHERE n.own != a.own) AS d FROM cell a JOIN n ON n.mask_id = a.mask_id AND n.x = a.x AND n.y = a.y AND n.z = a.z GROUP BY ALL),
b AS (SELECT mask_id, x, y, z, CASE WHEN d < 4 THEN 'boundary' WHEN own THEN 'inside' ELSE 'outside' END AS band FROM w WHERE d IS NULL OR d < 4)"""


@query(f"""{_WINDOW} SELECT mask_id, x, y, z, band FROM b
QUALIFY row_number() OVER (PARTITION BY mask_id, band ORDER BY md5(5 || ':' || mask_id || ':' || x || ':' || y || ':' || z)) <= CASE band WHEN 'boundary' THEN 400 ELSE 200 END""")
def sdf_band_samples(spark, sf_dir):
    field = transforms.distance_fields(*cohorts.masks(spark, sf_dir, "nation"), SHAPE)
    return inverse.band_samples(field, 800, seed=5).drop("d2")


@query(f"""{cohorts.oracle_cte('supplier')}, n AS (SELECT *, row_number() OVER (PARTITION BY mask_id ORDER BY x, y, z) - 1 AS at, count(*) OVER (PARTITION BY mask_id) AS n FROM voxel),
d AS (SELECT mask_id, draw::INT AS draw, {_uniform(3)} AS u FROM par, range(50) g(draw)) SELECT d.mask_id, draw, x, y, z FROM d JOIN n ON n.mask_id = d.mask_id AND n.at = floor(u * n)""")
def voxel_samples(spark, sf_dir):
    return inverse.repeated_samples(cohorts.masks(spark, sf_dir, "supplier")[1], 50, seed=3)


@query(f"""WITH d AS (SELECT {_KEY}, draw::INT AS draw FROM supplier, range(50) g(draw))
SELECT mask_id, draw, floor({_uniform(4)} * 16)::INT AS x, floor({_uniform(5)} * 16)::INT AS y, floor({_uniform(6)} * 16)::INT AS z FROM d""")
def cell_samples(spark, sf_dir):
    return inverse.uniform_samples(cohorts.masks(spark, sf_dir, "supplier")[0], SHAPE, 50, seed=4)


# Values of fits


def _radii(table: str) -> str:
    return f"""{cohorts.oracle_cte(table)}, m AS (SELECT mask_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, greatest(1, max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS side FROM voxel GROUP BY mask_id),
d AS (SELECT mask_id, side, x - mx AS dx, y - my AS dy, z - mz AS dz, sqrt((x-mx)*(x-mx) + (y-my)*(y-my) + (z-mz)*(z-mz)) AS r FROM voxel JOIN m USING (mask_id)),
g AS (SELECT mask_id, any_value(side) AS side, floor(acos(greatest(-1e0, least(1e0, dz / r))) / pi() * 63)::INT AS t,
  floor((CASE WHEN atan2(dy, dx) < 0 THEN atan2(dy, dx) + 2 * pi() ELSE atan2(dy, dx) END) / (2 * pi()) * 127)::INT AS p, max(r) AS r FROM d WHERE r > 0 GROUP BY mask_id, t, p)"""


@query(f"{_radii('supplier')} SELECT mask_id, t, p, {r('r')} AS r FROM g")
def radius_map_values(spark, sf_dir):
    return rounded(harmonics.radius_map(cohorts.masks(spark, sf_dir, "supplier")[1]), 6, "r")


@query(f"{_radii('supplier')} SELECT mask_id, {r('sum(r / (side / 2e0)) / sqrt(4 * pi()) / (count(*) / (4 * pi()) + 1e-9)')} AS c FROM g GROUP BY mask_id")
def sh_level(spark, sf_dir):
    """The fit of degree 0: the mean of the scaled radius map, over the constant harmonic."""
    return rounded(harmonics.harmonic_coefficients(*cohorts.masks(spark, sf_dir, "supplier"), SHAPE, lmax=0).select("mask_id", "c"), 6, "c")


@query(f"{_EDT} SELECT mask_id, {r('sum(sign(d2) * sqrt(abs(d2)) / 8) / (count(*) + 1e-3)')} AS c FROM sdf GROUP BY mask_id")
def cheby_level(spark, sf_dir):
    """The ridge fit of order 0."""
    out = transforms.polynomial_features(*cohorts.masks(spark, sf_dir, "nation"), SHAPE, 0, True, 1e-3)
    return rounded(out.select("mask_id", F.col("features")[0].alias("c")), 6, "c")
