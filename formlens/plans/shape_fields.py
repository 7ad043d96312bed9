"""More queries of the catalogue: blurred masks, surfaces at a level, and what starts from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chains, copies, decimation, fields, masks, mesh_modes, meshes, overlap, transforms
from ..sources import cohorts
from .catalogue import _EDT_MANY, _MANY, SHAPE, query, r, rounded

#: The blur of sigma 1 as three joins with a table of weights: r.w is what cell s gives to cell t, the mirrored ones included.
_BLUR = f"""{_MANY}, k AS (SELECT k, exp(-0.5e0 * k * k) AS e FROM range(-4, 5) g(k)),
r AS (SELECT t, CASE WHEN t + k < 0 THEN -1 - t - k WHEN t + k > 15 THEN 31 - t - k ELSE t + k END AS s, sum(e / (SELECT sum(e) FROM k)) AS w FROM range(16) g(t), k GROUP BY ALL),
b1 AS (SELECT mask_id, x, y, t::INT AS z, sum(w) AS v FROM voxel JOIN r ON s = z GROUP BY mask_id, x, y, t),
b2 AS (SELECT mask_id, x, t::INT AS y, z, sum(w * v) AS v FROM b1 JOIN r ON s = y GROUP BY mask_id, x, t, z),
b3 AS (SELECT mask_id, t::INT AS x, y, z, sum(w * v) AS v FROM b2 JOIN r ON s = x GROUP BY mask_id, t, y, z)"""


@query(f"{_BLUR} SELECT mask_id, x, y, z, {r('v')} AS v FROM b3 WHERE v > 0.05e0")
def gaussian_field(spark, sf_dir):
    return rounded(fields.gaussian_field(cohorts.masks(spark, sf_dir, "supplier")[1], SHAPE, 1.0, least=0.05), 6, "v")


#: An edge of the cells' tetrahedra goes 0 or 1 along each axis; where one end is at the level and the other isn't, a vertex lies.
_EDGES = f"""{_BLUR}, f AS (SELECT par.mask_id, gx.x, gy.y, gz.z, coalesce(b3.v, 0e0) AS v FROM par CROSS JOIN range(-1, 17) gx(x) CROSS JOIN range(-1, 17) gy(y) CROSS JOIN range(-1, 17) gz(z)
  LEFT JOIN b3 ON b3.mask_id = par.mask_id AND b3.x = gx.x AND b3.y = gy.y AND b3.z = gz.z),
d AS (SELECT i, j, k FROM range(2) a(i), range(2) b(j), range(2) c(k) WHERE i + j + k > 0),
p AS (SELECT f.*, i, j, k, x + i AS px, y + j AS py, z + k AS pz FROM f, d),
e AS (SELECT p.mask_id, p.x, p.y, p.z, i, j, k, (0.5e0 - p.v) / (q.v - p.v) AS t FROM p JOIN f q ON q.mask_id = p.mask_id AND q.x = px AND q.y = py AND q.z = pz
  WHERE (p.v >= 0.5e0 - 1e-12) != (q.v >= 0.5e0 - 1e-12))"""


@query(f"{_EDGES} SELECT mask_id, {r('x + i * t')} AS x, {r('y + j * t')} AS y, {r('z + k * t')} AS z FROM e")
def level_vertices(spark, sf_dir):
    return rounded(fields.level_mesh(cohorts.masks(spark, sf_dir, "supplier")[1], SHAPE)[0].drop("vid"), 6, "x", "y", "z")


@query()
def blurred_pdm_features(spark, sf_dir):
    """Point distributions of the blurred surfaces; tested by round trips and on a ball."""
    return chains.blurred_points(cohorts.masks(spark, sf_dir, "supplier")[1], SHAPE, subdivisions=2)


@query()
def vector_smooth_mask(spark, sf_dir):
    """Masks after a round trip through vector harmonics; tested as such."""
    return chains.smooth_vectors(cohorts.masks(spark, sf_dir, "supplier")[1], SHAPE, lmax=6)


@query()
def surface_distances_cohort(spark, sf_dir):
    """Both distances of all pairs of suppliers' masks; hausdorff_matrix and mean_surface_distance are the same with SQL, over fewer masks."""
    meta, voxel = cohorts.masks(spark, sf_dir, "supplier")
    return overlap.surface_distances(meta, masks.surface_points(voxel, SHAPE).distinct(), block=64)


@query("SELECT s_suppkey::BIGINT AS mask_id, k::INT AS k, true AS solved, k = 0 AS constant FROM supplier, range(8) g(k)")
def surface_modes_residual(spark, sf_dir):
    """The modes of the masks' surfaces, put back into the Laplacian by a join; only the first eigenvalue is 0."""

    def left(voxel):
        laplacian = meshes.cotangent_laplacian(*fields.level_mesh(voxel, SHAPE, 0.0))
        return mesh_modes.residuals(laplacian, mesh_modes.modes(laplacian, 8))

    return copies.once(cohorts.masks(spark, sf_dir, "supplier")[1], left).select("mask_id", "k", (F.col("residual") < 1e-8).alias("solved"), (F.abs("eigenvalue") < 1e-8).alias("constant"))


@query(f"{_MANY} SELECT par.mask_id, 60::BIGINT AS points, 2::BIGINT AS euler, 0::BIGINT AS open_edges, true AS near FROM par")
def decimated_surface(spark, sf_dir):
    """Surfaces of 60 vertices: as many as asked for, closed, of one piece without handles, with the volume of the voxels within a tenth."""

    def measured(voxel):
        vertices, faces = decimation.decimated(*fields.level_mesh(voxel, SHAPE, 0.0), 60)
        got = meshes.measures(vertices, faces).join(vertices.groupBy("mask_id").agg(F.count("*").alias("points")), "mask_id")
        return got.join(voxel.groupBy("mask_id").agg(F.count("*").alias("n")), "mask_id")

    return copies.once(cohorts.masks(spark, sf_dir, "supplier")[1], measured).select("mask_id", "points", "euler", "open_edges", (F.abs(F.col("volume") / F.col("n") - 1) < 0.1).alias("near"))


@query()
def mask_spectra(spark, sf_dir):
    """Normalised eigenvalues of the masks' surfaces; tested on a ball, whose are l (l + 1)."""
    rows = chains.mask_spectra(cohorts.masks(spark, sf_dir, "supplier")[1], SHAPE, 10, normalise=True)
    return rows.select("mask_id", F.posexplode("eigenvalues").alias("k", "eigenvalue"))


@query()
def laplace_chain(spark, sf_dir):
    """Modes of the decimated surfaces in their frames; tested as a round trip."""
    return chains.laplace_chain(cohorts.masks(spark, sf_dir, "supplier")[1], SHAPE, 12, 100)


def _normal_sql() -> str:
    """The sums of a Chebyshev fit of order 2 over all cells, as one list a mask."""
    power = lambda x: ("1e0", x, f"(2 * {x} * {x} - 1)")
    terms = [f"{power('w')[i]} * {power('v')[j]} * {power('u')[k]}" for i in range(3) for j in range(3 - i) for k in range(3 - i - j)]
    c = [f"c{n}" for n in range(len(terms))]
    sums = ["count(*)", "sum(f)", *[f"sum({a})" for a in c], *[f"sum({a} * f)" for a in c], *[f"sum({a} * {b})" for a in c for b in c]]
    return f"""{_EDT_MANY}, q AS (SELECT mask_id, (x - 8) / 8e0 AS u, (y - 8) / 8e0 AS v, (z - 8) / 8e0 AS w, sign(d2) * sqrt(abs(d2)) / 8e0 AS f FROM sdf),
c AS (SELECT mask_id, f, {', '.join(f'{t} AS {a}' for t, a in zip(terms, c, strict=True))} FROM q), s AS (SELECT mask_id, [{', '.join(sums)}] AS s FROM c GROUP BY mask_id)
SELECT mask_id, n::INT AS at, {r('s[n + 1]', 4)} AS v FROM s, range({len(sums)}) g(n)"""


@query(_normal_sql())
def fit_normal_sums(spark, sf_dir):
    """The normal equations of a Chebyshev fit of order 2 to the distances of all cells."""
    meta, voxel = cohorts.masks(spark, sf_dir, "supplier")
    known = transforms.frames_of(meta, voxel, SHAPE, True)
    sums = transforms.normal_sums(transforms.distance_fields(known, voxel, SHAPE, known=("centre", "scale")), 2, True)
    return rounded(sums.select("mask_id", "at", "v"), 4, "v")
