"""More queries of the catalogue: modes and samples of meshes, shapes from coefficients. The meshes and models are made of the suppliers' keys, so the SQL has their values in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mesh_modes, meshes
from ..sources import cohorts
from .catalogue import query, r, rounded

# Isosceles triangles: half base p, height q. Their Laplacian has the modes (2, -1, -1) for 3p / 2q and (0, 1, -1) for q / 2p.
_TRIANGLES = """WITH t AS (SELECT s_suppkey::BIGINT AS mask_id, (1 + s_suppkey % 5)::DOUBLE AS p, (2 + s_suppkey % 7)::DOUBLE AS q FROM supplier),
m AS (SELECT mask_id, p, q, 0 AS mode, 0e0 AS e, q / sqrt(3e0) AS norm FROM t UNION ALL SELECT mask_id, p, q, 1, 3 * p / (2 * q), 2 * q / sqrt(6e0) FROM t
  UNION ALL SELECT mask_id, p, q, 2, q / (2 * p), sqrt(2e0) * p FROM t),
o AS (SELECT *, (row_number() OVER (PARTITION BY mask_id ORDER BY e) - 1)::INT AS k FROM m)"""


def _triangles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("s_suppkey").cast("long")
    rows = cohorts.dealt(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(key.alias("mask_id"), (1.0 + key % 5).alias("p"), (2.0 + key % 7).alias("q")))
    zero = F.lit(0.0)
    corners = ((zero, F.col("q")), (-F.col("p"), zero), (F.col("p"), zero))
    points = F.array(*[F.struct(F.lit(n).cast("long").alias("vid"), x.alias("x"), y.alias("y"), zero.alias("z")) for n, (x, y) in enumerate(corners)])
    faces = rows.select("mask_id", *[F.lit(n).cast("long").alias(c) for n, c in enumerate(("fid", "j", "k"))], F.lit(0).cast("long").alias("i"))
    return cohorts.each(rows, "at", len(corners)).select("mask_id", points[F.col("at")].alias("v")).select("mask_id", "v.*"), faces.select("mask_id", "fid", "i", "j", "k")


def _modes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vertices, faces = _triangles(spark, sf_dir)
    return vertices, mesh_modes.modes(meshes.cotangent_laplacian(vertices, faces), 3)


@query(f"{_TRIANGLES} SELECT mask_id, k, {r('e')} AS eigenvalue, {r('norm')} AS norm FROM o")
def lb_coefficients(spark, sf_dir):
    """Eigenvalues and, as modes may point both ways, the norms of their coefficients."""
    out = mesh_modes.coefficients(*_modes(spark, sf_dir))
    return rounded(out.select("mask_id", "k", "eigenvalue", F.sqrt(F.expr("cx * cx + cy * cy + cz * cz")).alias("norm")), 6, "eigenvalue", "norm")


@query(f"""{_TRIANGLES} SELECT mask_id, k, {r('e / min(CASE WHEN k = 1 THEN e END) OVER w')} AS eigenvalue, {r('norm / sqrt(sum(norm * norm) OVER w)')} AS invariant
FROM o WINDOW w AS (PARTITION BY mask_id) QUALIFY k > 0""")
def lb_invariants(spark, sf_dir):
    return rounded(mesh_modes.invariants(mesh_modes.coefficients(*_modes(spark, sf_dir))), 6, "eigenvalue", "invariant")


@query(f"{_TRIANGLES} SELECT mask_id, k, {r('e / max(e) OVER (PARTITION BY mask_id)')} AS eigenvalue FROM o QUALIFY k > 0")
def lb_eigenvalues(spark, sf_dir):
    out = mesh_modes.spectra(meshes.cotangent_laplacian(*_triangles(spark, sf_dir)), 3, normalise=True)
    out = out.select("mask_id", F.posexplode("eigenvalues").alias("k", "eigenvalue")).withColumn("k", F.col("k") + 1)
    return rounded(out, 6, "eigenvalue")


@query(f"""{_TRIANGLES}, s AS (SELECT *, q * q > 3 * p * p AS tall FROM t) SELECT mask_id, 0::BIGINT AS vid, 0e0 AS x, {r('CASE WHEN tall THEN q ELSE q / 3 END')} AS y, 0e0 AS z FROM s
UNION ALL SELECT mask_id, vid, {r('CASE WHEN tall THEN 0 ELSE (2 * vid - 3) * p END')}, {r('CASE WHEN tall THEN 0 ELSE q / 3 END')}, 0e0 FROM s, range(1, 3) g(vid)""")
def lb_process(spark, sf_dir):
    """A third of the modes: the height alone of tall triangles, the base alone of flat ones, put back where they were."""
    return rounded(mesh_modes.process(*_triangles(spark, sf_dir), 3, threshold=33.0)[1], 6, "x", "y", "z")


# Patches of 6 x 6 vertices, with heights from the key.
_PATCHES = """WITH v AS (SELECT s_suppkey::BIGINT AS mask_id, (i * 6 + j)::BIGINT AS vid, i::DOUBLE AS x, j::DOUBLE AS y, ((i * (1 + s_suppkey % 3) + j * (1 + s_suppkey % 4)) % 5) / 2e0 AS z
  FROM supplier, range(6) gi(i), range(6) gj(j)),
f AS (SELECT s_suppkey::BIGINT AS mask_id, 2 * (i * 5 + j) + h AS fid, CASE h WHEN 0 THEN 6 * i + j ELSE 6 * i + j + 6 END AS i, CASE h WHEN 0 THEN 6 * i + j + 6 ELSE 6 * i + j + 7 END AS j, 6 * i + j + 1 AS k
  FROM supplier, range(5) gi(i), range(5) gj(j), range(2) gh(h))"""


def _patches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    keys = cohorts.dealt(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("mask_id")))

    def grid(**sizes: int) -> DataFrame:
        rows = keys
        for name, n in sizes.items():
            rows = cohorts.each(rows, name, n).withColumn(name, F.col(name).cast("long"))
        return rows

    points = grid(i=6, j=6)
    points = points.select("mask_id", F.expr("i * 6 + j").alias("vid"), F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"),
                           F.expr("(i * (1 + mask_id % 3) + j * (1 + mask_id % 4)) % 5 / 2D").alias("z"))
    faces = grid(p=5, q=5, h=2).withColumn("v", F.expr("6 * p + q"))
    return points, faces.select("mask_id", F.expr("2 * (p * 5 + q) + h").alias("fid"), F.expr("v + 6 * h").alias("i"), F.expr("v + 6 + h").alias("j"), F.expr("v + 1").alias("k"))


@query(f"{_PATCHES} SELECT mask_id, vid, x, y, z FROM v")
def lb_surface_back(spark, sf_dir):
    """All modes together give the surface again, from its frame back to where it was."""
    return rounded(mesh_modes.process(*_patches(spark, sf_dir), 36)[1], 6, "x", "y", "z")


@query(f"""{_PATCHES}, m AS (SELECT *, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy, z - avg(z) OVER w AS dz FROM v WINDOW w AS (PARTITION BY mask_id)),
s AS (SELECT mask_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(dx * dx + dy * dy + dz * dz) AS s2, sum(dx * dx) / 35 AS xx, sum(dy * dy) / 35 AS yy, sum(dz * dz) / 35 AS zz,
  sum(dx * dy) / 35 AS xy, sum(dx * dz) / 35 AS xz, sum(dy * dz) / 35 AS yz FROM m GROUP BY mask_id)
SELECT mask_id, {r('mx')} AS mx, {r('my')} AS my, {r('mz')} AS mz, {r('sqrt(s2)')} AS scale, {r('(xx + yy + zz) / s2')} AS trace,
{r('(xx * yy + yy * zz + zz * xx - xy * xy - yz * yz - xz * xz) / (s2 * s2)')} AS minors, {r('(xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)) / pow(s2, 3)')} AS det FROM s""")
def mesh_frame(spark, sf_dir):
    """Centroid, scale and, as they fix the variances along the axes, the covariance's trace, minors and determinant; measured on the aligned vertices."""
    vertices, _ = _patches(spark, sf_dir)
    frame = mesh_modes.frames(vertices)
    spread = mesh_modes.aligned(vertices, frame).groupBy("mask_id").agg(*[F.var_samp(c).alias(f"v{c}") for c in "xyz"])
    out = frame.join(spread, "mask_id").select(
        "mask_id", *[F.col("centroid")[i].alias(f"m{c}") for i, c in enumerate("xyz")], "scale", F.expr("vx + vy + vz").alias("trace"),
        F.expr("vx * vy + vy * vz + vz * vx").alias("minors"), F.expr("vx * vy * vz").alias("det"))
    return rounded(out, 6, *out.columns[1:])


_CLUSTERS = """, q AS (SELECT *, floor(x / 2) AS qx, floor(y / 2) AS qy, floor(z / 2) AS qz FROM v),
c AS (SELECT mask_id, qx, qy, qz, min(vid) AS t, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM q GROUP BY ALL), n AS (SELECT q.mask_id, q.vid, c.t FROM q JOIN c USING (mask_id, qx, qy, qz))"""


@query(f"{_PATCHES}{_CLUSTERS} SELECT mask_id, t AS vid, {r('x')} AS x, {r('y')} AS y, {r('z')} AS z FROM c")
def mesh_decimate_vertices(spark, sf_dir):
    return rounded(mesh_modes.clustered(*_patches(spark, sf_dir), 2.0)[0], 6, "x", "y", "z")


@query(f"""{_PATCHES}{_CLUSTERS}, g AS (SELECT f.mask_id, fid, a.t AS i, b.t AS j, c.t AS k FROM f JOIN n a ON a.mask_id = f.mask_id AND a.vid = f.i JOIN n b ON b.mask_id = f.mask_id AND b.vid = f.j
  JOIN n c ON c.mask_id = f.mask_id AND c.vid = f.k WHERE a.t != b.t AND b.t != c.t AND c.t != a.t),
h AS (SELECT mask_id, fid, CASE least(i, j, k) WHEN i THEN [i, j, k] WHEN j THEN [j, k, i] ELSE [k, i, j] END AS v FROM g)
SELECT mask_id, min(fid) AS fid, v[1] AS i, v[2] AS j, v[3] AS k FROM h GROUP BY mask_id, v""")
def mesh_decimate_faces(spark, sf_dir):
    return mesh_modes.clustered(*_patches(spark, sf_dir), 2.0)[1]


def _uniform(seed: int, text: str) -> str:
    return f"('0x' || substr(md5({seed} || ':' || mask_id || ':' || {text}), 1, 8))::BIGINT / 4294967296e0"


@query(f"""{_PATCHES}, s AS (SELECT f.mask_id, fid, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz,
  sqrt(pow((b.y-a.y)*(c.z-a.z) - (b.z-a.z)*(c.y-a.y), 2) + pow((b.z-a.z)*(c.x-a.x) - (b.x-a.x)*(c.z-a.z), 2) + pow((b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x), 2)) / 2 AS area
  FROM f JOIN v a ON a.mask_id = f.mask_id AND a.vid = f.i JOIN v b ON b.mask_id = f.mask_id AND b.vid = f.j JOIN v c ON c.mask_id = f.mask_id AND c.vid = f.k),
n AS (SELECT *, floor(100 * area / sum(area) OVER (PARTITION BY mask_id) + {_uniform(7, 'fid')})::INT AS n FROM s), e AS (SELECT *, unnest(range(n)) AS s FROM n),
u AS (SELECT *, sqrt({_uniform(8, "fid || ':' || s")}) AS g, {_uniform(9, "fid || ':' || s")} AS h FROM e)
SELECT mask_id, fid, s::INT AS s, {r('(1 - g) * ax + g * (1 - h) * bx + g * h * cx')} AS x, {r('(1 - g) * ay + g * (1 - h) * by_ + g * h * cy')} AS y, {r('(1 - g) * az + g * (1 - h) * bz + g * h * cz')} AS z FROM u""")
def mesh_surface_samples(spark, sf_dir):
    return rounded(mesh_modes.surface_samples(*_patches(spark, sf_dir), 100, seed=7), 6, "x", "y", "z")


_CORNERS = """, t AS (SELECT f.mask_id, f.fid, f.i, f.j, f.k, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS yb, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz
  FROM f JOIN v a ON a.mask_id = f.mask_id AND a.vid = f.i JOIN v b ON b.mask_id = f.mask_id AND b.vid = f.j JOIN v c ON c.mask_id = f.mask_id AND c.vid = f.k)"""


@query(f"""{_PATCHES}{_CORNERS}, e AS (SELECT mask_id, unnest([i, j, k]) AS vid, (ax + bx + cx) / 3 AS x, (ay + yb + cy) / 3 AS y, (az + bz + cz) / 3 AS z FROM t),
n AS (SELECT mask_id, vid, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM e GROUP BY ALL),
h AS (SELECT v.mask_id, v.vid, (v.x + n.x) / 2 AS x, (v.y + n.y) / 2 AS y, (v.z + n.z) / 2 AS z FROM v JOIN n USING (mask_id, vid)),
m AS (SELECT mask_id, vid, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM h WINDOW w AS (PARTITION BY mask_id)),
d AS (SELECT *, sqrt(x * x + y * y + z * z) + 1e-9 AS len FROM m) SELECT mask_id, vid, {r('x / len')} AS x, {r('y / len')} AS y, {r('z / len')} AS z FROM d""")
def inflation_step_values(spark, sf_dir):
    return rounded(meshes.inflation_step(*_patches(spark, sf_dir)), 6, "x", "y", "z")


def _cot(a: str, b: str, c: str) -> str:
    """The cotangent at the corner whose coordinates are named first."""
    u, w = ([f"({q} - {p})" for p, q in zip(a.split(), o.split(), strict=True)] for o in (b, c))
    cross = [f"pow({u[i]} * {w[j]} - {u[j]} * {w[i]}, 2)" for i, j in ((0, 1), (1, 2), (0, 2))]
    return f"({' + '.join(f'{p} * {q}' for p, q in zip(u, w, strict=True))}) / (sqrt({' + '.join(cross)}) + 1e-10)"


_A, _B, _C = "ax ay az", "bx yb bz", "cx cy cz"


@query(f"""{_PATCHES}{_CORNERS}, s AS (SELECT mask_id, j AS p, k AS q, {_cot(_A, _B, _C)} AS w FROM t UNION ALL SELECT mask_id, k, i, {_cot(_B, _C, _A)} FROM t UNION ALL SELECT mask_id, i, j, {_cot(_C, _A, _B)} FROM t),
e AS (SELECT mask_id, p AS i, q AS j, w / 2 AS w FROM s UNION ALL SELECT mask_id, q, p, w / 2 FROM s)
SELECT mask_id, i, j, {r('-sum(w)')} AS w FROM e GROUP BY mask_id, i, j UNION ALL SELECT mask_id, i, i, {r('sum(w)')} FROM e GROUP BY mask_id, i""")
def cot_laplacian_values(spark, sf_dir):
    return rounded(meshes.cotangent_laplacian(*_patches(spark, sf_dir)), 6, "w")
