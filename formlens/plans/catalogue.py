"""The queries over the driver's tables, by name, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import linear
from ..operators import cohort_model, harmonics, masks, meshes, moments, overlap, transforms
from ..sources import cohorts

SHAPE = (cohorts.GRID,) * 3
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_MANY, _FEW = cohorts.oracle_cte("supplier"), cohorts.oracle_cte("nation")


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in names})


def r(text: str, digits: int = 6) -> str:
    return f"round({text}, {digits}) + 0e0"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as features."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("mask_id"), F.col("embedding").cast("array<double>").alias("features"))


# Masks


@query(f"{_MANY} SELECT mask_id, x, y, z FROM voxel")
def mask_voxels(spark, sf_dir):
    return cohorts.masks(spark, sf_dir, "supplier")[1]


@query(f"""{_MANY} SELECT mask_id, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z
FROM voxel GROUP BY mask_id""")
def mask_volume_bbox(spark, sf_dir):
    return masks.bounding_boxes(cohorts.masks(spark, sf_dir, "supplier")[1])


@query(f"{_MANY} SELECT mask_id, (CASE WHEN side = 'left' THEN 15 - x ELSE x END)::INT AS x, y, z FROM voxel JOIN par USING (mask_id)")
def mask_flip_left(spark, sf_dir):
    return masks.flip_left(*cohorts.masks(spark, sf_dir, "supplier"), SHAPE[0])


_OFFSETS = "o(i, j, k) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))"
_SURFACE = f"""{_FEW}, {_OFFSETS}, sp AS (SELECT mask_id, 2 * x + i AS x2, 2 * y + j AS y2, 2 * z + k AS z2 FROM voxel v, o
  WHERE x + i BETWEEN 0 AND 15 AND y + j BETWEEN 0 AND 15 AND z + k BETWEEN 0 AND 15
  AND NOT EXISTS (FROM voxel w WHERE w.mask_id = v.mask_id AND w.x = v.x + i AND w.y = v.y + j AND w.z = v.z + k))"""


@query(f"{_SURFACE} SELECT mask_id, x2, y2, z2 FROM sp")
def surface_points(spark, sf_dir):
    return masks.surface_points(cohorts.masks(spark, sf_dir, "nation")[1], SHAPE)


_DILATED = f"""{_FEW}, {_OFFSETS}, d AS (SELECT DISTINCT mask_id, x + i AS x, y + j AS y, z + k AS z FROM voxel, (FROM o UNION ALL SELECT 0, 0, 0)
  WHERE x + i BETWEEN 0 AND 15 AND y + j BETWEEN 0 AND 15 AND z + k BETWEEN 0 AND 15)"""
_KEEP = "NOT EXISTS (FROM o WHERE NOT EXISTS (FROM {0} w WHERE w.mask_id = v.mask_id AND w.x = v.x + i AND w.y = v.y + j AND w.z = v.z + k))"


@query(f"{_DILATED} SELECT mask_id, x, y, z FROM d")
def dilate(spark, sf_dir):
    return masks.dilate(cohorts.masks(spark, sf_dir, "nation")[1], SHAPE)


@query(f"""{_FEW}, {_OFFSETS}, c AS (SELECT v.mask_id, v.x, v.y, v.z, count(*) AS n FROM voxel v, o JOIN voxel w
  ON w.mask_id = v.mask_id AND w.x = v.x + i AND w.y = v.y + j AND w.z = v.z + k GROUP BY ALL) SELECT mask_id, x, y, z FROM c WHERE n = 6""")
def erode(spark, sf_dir):
    return masks.erode(cohorts.masks(spark, sf_dir, "nation")[1])


@query(f"""{_DILATED}, c AS (SELECT v.mask_id, v.x, v.y, v.z, count(*) AS n FROM d v, o JOIN d w
  ON w.mask_id = v.mask_id AND w.x = v.x + i AND w.y = v.y + j AND w.z = v.z + k GROUP BY ALL) SELECT mask_id, x, y, z FROM c WHERE n = 6""")
def close(spark, sf_dir):
    return masks.close(cohorts.masks(spark, sf_dir, "nation")[1], SHAPE)


def _hollow(voxel: DataFrame) -> DataFrame:
    """Without the inner voxels, so holes are left to fill."""
    return voxel.join(masks.erode(voxel), ["mask_id", "x", "y", "z"], "left_anti")


@query(f"{_FEW} SELECT mask_id, x, y, z FROM voxel")
def fill_holes(spark, sf_dir):
    """Shells of the masks, filled: the masks again."""
    meta, voxel = cohorts.masks(spark, sf_dir, "nation")
    return masks.fill_holes(meta, _hollow(voxel), SHAPE)


@query(f"{_FEW} SELECT mask_id, count(*) AS n, 1::BIGINT AS components FROM voxel GROUP BY mask_id")
def largest_component(spark, sf_dir):
    """Ellipsoids are in one piece."""
    parts = masks.components(*cohorts.masks(spark, sf_dir, "nation"), SHAPE)
    return parts.groupBy("mask_id", "component").agg(F.count("*").alias("n")).groupBy("mask_id").agg(F.max("n").alias("n"), F.count("*").alias("components"))


@query(f"""{_DILATED}, c AS (SELECT v.mask_id, v.x, v.y, v.z, count(*) AS n FROM d v, o JOIN d w
  ON w.mask_id = v.mask_id AND w.x = v.x + i AND w.y = v.y + j AND w.z = v.z + k GROUP BY ALL) SELECT mask_id, count(*) AS n FROM c WHERE n = 6 GROUP BY mask_id""")
def preprocess_volume(spark, sf_dir):
    """Ellipsoids are in one piece and have no holes, so only the closing changes them."""
    done = masks.preprocess(*cohorts.masks(spark, sf_dir, "nation"), SHAPE, min_size=100, closing_radius=1)
    return done.groupBy("mask_id").agg(F.count("*").alias("n"))


# Pairs

_COO = """, n AS (SELECT mask_id, count(*) AS n FROM voxel GROUP BY mask_id),
i AS (SELECT a.mask_id AS id_a, b.mask_id AS id_b, count(*) AS i FROM voxel a JOIN voxel b ON a.x = b.x AND a.y = b.y AND a.z = b.z AND a.mask_id <= b.mask_id GROUP BY ALL),
p AS (SELECT a.mask_id AS id_a, b.mask_id AS id_b, a.n AS na, b.n AS nb, coalesce(i, 0) AS i FROM n a JOIN n b ON a.mask_id <= b.mask_id LEFT JOIN i ON id_a = a.mask_id AND id_b = b.mask_id)"""


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    meta, voxel = cohorts.masks(spark, sf_dir, "supplier")
    return meta, masks.volumes(meta, voxel), masks.packed(voxel, SHAPE)


@query(f"{_MANY}{_COO} SELECT id_a, id_b, 2e0 * i / (na + nb) AS dice FROM p")
def dice_matrix_packed(spark, sf_dir):
    return overlap.dice_packed(*_packed(spark, sf_dir))


@query(f"{_MANY}{_COO} SELECT id_a, id_b, 2e0 * i / (na + nb) AS dice FROM p")
def dice_matrix_gram(spark, sf_dir):
    return overlap.dice_gram(*_packed(spark, sf_dir))


@query(f"{_MANY}{_COO} SELECT id_a, id_b, {r('2e0 * i / (na + nb + 1e-9)', 9)} AS dice FROM p")
def dice_eps_variant(spark, sf_dir):
    return rounded(overlap.dice_packed(*_packed(spark, sf_dir), epsilon=1e-9), 9, "dice")


@query("""WITH voxel AS (SELECT DISTINCT l_suppkey AS mask_id, l_partkey AS v FROM lineitem), n AS (SELECT mask_id, count(*) AS n FROM voxel GROUP BY mask_id),
i AS (SELECT a.mask_id AS id_a, b.mask_id AS id_b, count(*) AS i FROM voxel a JOIN voxel b ON a.v = b.v AND a.mask_id <= b.mask_id GROUP BY ALL)
SELECT a.mask_id AS id_a, b.mask_id AS id_b, 2e0 * coalesce(i, 0) / (a.n + b.n) AS dice
FROM n a JOIN n b ON a.mask_id <= b.mask_id LEFT JOIN i ON id_a = a.mask_id AND id_b = b.mask_id""")
def dice_sparse_supplier_parts(spark, sf_dir):
    """Suppliers as sets of parts: long, sparse masks, of which few share a word's parts."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("mask_id"), "l_partkey")
    return overlap.dice_sparse(items.select("mask_id").distinct(), items, "l_partkey")


@query(f"""{_MANY}{_COO} SELECT a.label AS label_a, b.label AS label_b, count(*) AS pairs, {r('avg(2e0 * i / (na + nb))')} AS mean_dice, min(2e0 * i / (na + nb)) AS min_dice
FROM p JOIN par a ON a.mask_id = id_a JOIN par b ON b.mask_id = id_b GROUP BY ALL""")
def label_pair_dice_summary(spark, sf_dir):
    meta, sizes, words = _packed(spark, sf_dir)
    dice = overlap.dice_gram(meta, sizes, words, also=("label",))
    out = dice.groupBy("label_a", "label_b").agg(F.count("*").alias("pairs"), F.avg("dice").alias("mean_dice"), F.min("dice").alias("min_dice"))
    return rounded(out, 6, "mean_dice")


@query(f"""{_MANY}{_COO}, m AS (SELECT id_a, id_b, 2e0 * i / (na + nb) AS dice FROM p WHERE id_a < id_b UNION ALL SELECT id_b, id_a, 2e0 * i / (na + nb) FROM p WHERE id_a < id_b)
SELECT id_a, id_b, dice, rank FROM (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY dice DESC, id_b)::INT AS rank FROM m) WHERE rank <= 3""")
def nearest_mask_topk(spark, sf_dir):
    return overlap.nearest_gram(*_packed(spark, sf_dir), 3)


_NEAR = """, near AS (SELECT a.mask_id AS id_a, b.mask_id AS id_b, a.x2, a.y2, a.z2, min((a.x2-b.x2)*(a.x2-b.x2) + (a.y2-b.y2)*(a.y2-b.y2) + (a.z2-b.z2)*(a.z2-b.z2)) AS d2 FROM sp a, sp b GROUP BY ALL),
way AS (SELECT id_a, id_b, max(d2) AS far, avg(sqrt(d2) / 2) AS mean FROM (SELECT DISTINCT id_a, id_b, x2, y2, z2, d2 FROM near) GROUP BY ALL)"""


@query(f"{_SURFACE}{_NEAR} SELECT id_a, id_b, sqrt(max(far)) / 2 AS hausdorff FROM (SELECT least(id_a, id_b) AS id_a, greatest(id_a, id_b) AS id_b, far FROM way) GROUP BY ALL")
def hausdorff_matrix(spark, sf_dir):
    meta, voxel = cohorts.masks(spark, sf_dir, "nation")
    return overlap.surface_distances(meta, masks.surface_points(voxel, SHAPE).distinct()).select("id_a", "id_b", "hausdorff")


@query(f"{_SURFACE}{_NEAR} SELECT id_a, id_b, {r('avg(mean)')} AS mean_dist FROM (SELECT least(id_a, id_b) AS id_a, greatest(id_a, id_b) AS id_b, mean FROM way) GROUP BY ALL")
def mean_surface_distance(spark, sf_dir):
    meta, voxel = cohorts.masks(spark, sf_dir, "nation")
    out = overlap.surface_distances(meta, masks.surface_points(voxel, SHAPE).distinct()).select("id_a", "id_b", "mean_dist")
    return rounded(out, 6, "mean_dist")


# Moments and alignment

_P = ("xx", "yy", "zz", "xy", "xz", "yz")
_COV = ", ".join(f"{r(f'covar_samp({p[0]}, {p[1]})')} AS c_{p}" for p in _P)


@query(f"{_MANY} SELECT mask_id, count(*) AS n, {r('avg(x)')} AS m_x, {r('avg(y)')} AS m_y, {r('avg(z)')} AS m_z, {_COV} FROM voxel GROUP BY mask_id")
def centroid_covariance(spark, sf_dir):
    out = moments.covariances(cohorts.masks(spark, sf_dir, "supplier")[1])
    return rounded(out, 6, *[c for c in out.columns if c[:2] in ("m_", "c_")])


@query(f"""{_MANY}, c AS (SELECT mask_id, {', '.join(f'covar_samp({p[0]}, {p[1]}) AS {p}' for p in _P)} FROM voxel GROUP BY mask_id),
q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM c),
s AS (SELECT *, sqrt(((xx-q)*(xx-q) + (yy-q)*(yy-q) + (zz-q)*(zz-q) + 2 * (xy*xy + xz*xz + yz*yz)) / 6) AS p,
  (xx-q)*((yy-q)*(zz-q) - yz*yz) - xy*(xy*(zz-q) - yz*xz) + xz*(xy*yz - (yy-q)*xz) AS d FROM q),
e AS (SELECT *, CASE WHEN p < 1e-9 THEN q ELSE q + 2 * p * cos(acos(greatest(-1e0, least(1e0, d / (2 * p * p * p)))) / 3) END AS l1,
  CASE WHEN p < 1e-9 THEN q ELSE q + 2 * p * cos(acos(greatest(-1e0, least(1e0, d / (2 * p * p * p)))) / 3 + 2.0943951023931953e0) END AS l3 FROM s)
SELECT mask_id, {r('l1')} AS l1, {r('3 * q - l1 - l3')} AS l2, {r('l3')} AS l3 FROM e""")
def principal_variances(spark, sf_dir):
    return rounded(moments.principal_variances(cohorts.masks(spark, sf_dir, "supplier")[1]), 6, "l1", "l2", "l3")


_W = ", ".join(f"{r(f'sum((1e0 + x) * {p[0]} * {p[1]}) - sum((1e0 + x) * {p[0]}) * sum((1e0 + x) * {p[1]}) / sum(1e0 + x)', 4)} AS i_{p}" for p in _P)


@query(f"{_MANY} SELECT mask_id, sum(1e0 + x) AS mass, {', '.join(f'{r(f"sum((1e0 + x) * {c}) / sum(1e0 + x)")} AS m_{c}' for c in 'xyz')}, {_W} FROM voxel GROUP BY mask_id")
def weighted_inertia(spark, sf_dir):
    volume = cohorts.masks(spark, sf_dir, "supplier")[1].withColumn("v", 1.0 + F.col("x"))
    out = rounded(moments.weighted_inertia(volume), 6, "m_x", "m_y", "m_z")
    return rounded(out, 4, *[f"i_{p}" for p in _P])


_OFF = """, s AS (SELECT mask_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz FROM voxel GROUP BY mask_id),
d AS (SELECT mask_id, (n * x - sx)::DOUBLE AS dx, (n * y - sy)::DOUBLE AS dy, (n * z - sz)::DOUBLE AS dz FROM voxel JOIN s USING (mask_id))"""


@query(f"""{_MANY}{_OFF}, c AS (SELECT mask_id, count(*) FILTER (WHERE dz > 0 AND dz * dz >= 0.5e0 * (dx*dx + dy*dy + dz*dz)) AS forward,
  count(*) FILTER (WHERE dz < 0 AND dz * dz >= 0.5e0 * (dx*dx + dy*dy + dz*dz)) AS backward FROM d GROUP BY mask_id)
SELECT mask_id, forward, backward, CASE WHEN forward + backward > 0 THEN abs(forward - backward) / (forward + backward) ELSE 0e0 END AS skew, forward > backward AS flip FROM c""")
def cone_orientation(spark, sf_dir):
    return moments.cone_orientation(cohorts.masks(spark, sf_dir, "supplier")[1])


@query(f"""{_FEW}{_OFF}, t AS (SELECT mask_id, g, dx * cos(radians(g)) + dy * sin(radians(g)) AS along, dx*dx + dy*dy + dz*dz AS n2 FROM d, range(180) gg(g)),
c AS (SELECT mask_id, g, least(count(*) FILTER (WHERE along < 0), count(*) FILTER (WHERE along >= 0)) AS m FROM t WHERE n2 > 0 AND along * along >= pow(cos(radians(15)), 2) * n2 GROUP BY ALL)
SELECT mask_id, min(m) AS min_mass, count(*) FILTER (WHERE m = least_m) AS n_directions FROM (SELECT *, min(m) OVER (PARTITION BY mask_id) AS least_m FROM c) GROUP BY mask_id""")
def cone_sweep(spark, sf_dir):
    return moments.cone_sweep(cohorts.masks(spark, sf_dir, "nation")[1]).select("mask_id", "min_mass", "n_directions")


@query(f"{_FEW} SELECT mask_id, 1e0 AS det, 0e0 AS off, {r('avg(x)')} AS cx FROM voxel GROUP BY mask_id")
def canonical_axes(spark, sf_dir):
    """The axes are orthonormal and right-handed: determinant 1, and nothing off the diagonal of their products."""
    out = moments.canonical_axes(*cohorts.masks(spark, sf_dir, "nation"), SHAPE)
    a = lambda i, j: F.col("axes")[3 * i + j]
    det = sum(a(0, j) * (a(1, (j + 1) % 3) * a(2, (j + 2) % 3) - a(1, (j + 2) % 3) * a(2, (j + 1) % 3)) for j in range(3))
    off = sum(F.abs(sum(a(k, i) * a(k, j) for k in range(3))) for i, j in ((0, 1), (0, 2), (1, 2)))
    return rounded(out.select("mask_id", det.alias("det"), off.alias("off"), "cx"), 6, "det", "off", "cx")


@query(f"""{_FEW}, ref AS (SELECT x, y, z FROM voxel WHERE mask_id = 0), a(angle, c, s) AS (VALUES (0e0, 1, 0), (90e0, 0, 1), (180e0, -1, 0), (270e0, 0, -1)),
t AS (SELECT mask_id, angle, (c * (2 * gx.x - 15) + s * (2 * gy.y - 15) + 15) // 2 AS sx, (-s * (2 * gx.x - 15) + c * (2 * gy.y - 15) + 15) // 2 AS sy, gx.x AS ox, gy.y AS oy
  FROM (SELECT DISTINCT mask_id FROM par), a, range(16) gx(x), range(16) gy(y)),
m AS (SELECT t.mask_id, angle, ox, oy, v.z FROM t JOIN voxel v ON v.mask_id = t.mask_id AND v.x = sx AND v.y = sy),
d AS (SELECT m.mask_id, angle, 2e0 * count(ref.x) / (count(*) + (SELECT count(*) FROM ref)) AS dice FROM m LEFT JOIN ref ON ref.x = ox AND ref.y = oy AND ref.z = m.z GROUP BY ALL)
SELECT mask_id, angle, dice FROM (SELECT *, row_number() OVER (PARTITION BY mask_id ORDER BY dice DESC, angle) AS k FROM d) WHERE k = 1""")
def rotate_to_ref(spark, sf_dir):
    meta, voxel = cohorts.masks(spark, sf_dir, "nation")
    reference = masks.dense(voxel.filter("mask_id = 0").toPandas(), SHAPE)  # the reference: one mask of a known grid
    return moments.rotate_to(reference, meta, voxel, step=90.0)


@query(f"""WITH par AS ({_MANY.split("AS (", 1)[1].split("),", 1)[0]}) SELECT mask_id, i, j, (CASE WHEN i = 3 THEN CASE WHEN j = 3 THEN 1 ELSE 0 END
  WHEN j = (i + mask_id) % 3 THEN 2 + j WHEN j = 3 THEN CASE (i + mask_id) % 3 WHEN 0 THEN a - cx WHEN 1 THEN b - cy ELSE c - cz END ELSE 0 END)::DOUBLE AS v
  FROM par, range(4) gi(i), range(4) gj(j)""")
def affine_compose(spark, sf_dir):
    """An affine of spacings 2, 3, 4 and origin (a, b, c), taken into permuted axes about (cx, cy, cz)."""
    shapes = cohorts.ellipsoids(spark, sf_dir, "supplier")
    number = lambda c: c.cast("double")
    affine = F.array(*[F.array(*[F.lit(float(2 + i)) if i == j else number(F.col("abc"[i])) if j == 3 else F.lit(0.0) for j in range(4)]) for i in range(3)], F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)]))
    axes = F.array(*[F.array(*[F.when((i + F.col("mask_id")) % 3 == j, 1.0).otherwise(0.0) for j in range(3)]) for i in range(3)])
    centre = F.array(*[number(F.col(c)) for c in ("cx", "cy", "cz")])
    out = shapes.select("mask_id", linear.affine_product(linear.into_axes(axes, centre), affine).alias("m"))
    out = out.select("mask_id", F.posexplode("m").alias("i", "row")).select("mask_id", F.col("i").cast("long"), F.posexplode("row").alias("j", "v"))
    return out.select("mask_id", "i", F.col("j").cast("long").alias("j"), (F.col("v") + 0.0).alias("v"))


@query(f"{_FEW} SELECT DISTINCT mask_id, true AS close FROM voxel")
def normalize_resample(spark, sf_dir):
    """The resampled masks have the target volume, within a tenth: source voxels are three cells wide."""
    meta, voxel = cohorts.masks(spark, sf_dir, "nation")
    flipped = masks.flip_left(meta, voxel, SHAPE[0])
    out = moments.normalised(meta, flipped, SHAPE, size=96, volume=27_000.0)
    return out.groupBy("mask_id").agg(F.count("*").between(24_300, 29_700).alias("close"))


# Distances and transforms

def _edt(voxels: str) -> str:
    """Distances by three minima, axis by axis: s to the mask, t to its outside; a cell of the mask has s = 0."""
    least = lambda u: ", ".join(f"min({c} + ({u} - n) * ({u} - n)) AS {c}" for c in "st")
    return f"""{voxels}, cell AS (SELECT g.mask_id, g.x, g.y, g.z, CASE WHEN v.x IS NULL THEN 1000000 ELSE 0 END AS s, CASE WHEN v.x IS NULL THEN 0 ELSE 1000000 END AS t
  FROM (SELECT mask_id, gx.x::INT AS x, gy.y::INT AS y, gz.z::INT AS z FROM par, range(16) gx(x), range(16) gy(y), range(16) gz(z)) g
  LEFT JOIN voxel v ON v.mask_id = g.mask_id AND v.x = g.x AND v.y = g.y AND v.z = g.z),
e1 AS (SELECT mask_id, n::INT AS x, y, z, {least('x')} FROM cell, range(16) g(n) GROUP BY mask_id, n, y, z),
e2 AS (SELECT mask_id, x, n::INT AS y, z, {least('y')} FROM e1, range(16) g(n) GROUP BY mask_id, x, n, z),
e3 AS (SELECT mask_id, x, y, n::INT AS z, {least('z')} FROM e2, range(16) g(n) GROUP BY mask_id, x, y, n),
sdf AS (SELECT mask_id, x, y, z, (CASE WHEN s = 0 THEN -t ELSE s END)::BIGINT AS d2 FROM e3)"""


_EDT, _EDT_MANY = _edt(_FEW), _edt(_MANY)


@query(f"{_EDT_MANY} SELECT mask_id, x, y, z, d2 FROM sdf")
def edt_sdf(spark, sf_dir):
    return transforms.distance_fields(*cohorts.masks(spark, sf_dir, "supplier"), SHAPE)


def _root(d2: Column) -> Column:
    return F.signum(d2) * F.sqrt(F.abs(d2).cast("double"))


@query(f"{_EDT_MANY} SELECT mask_id, x, y, z, {r('5e0 * tanh(sign(d2) * sqrt(abs(d2)) / 5e0)')} AS v FROM sdf")
def sdf_saturated(spark, sf_dir):
    fields = transforms.distance_fields(*cohorts.masks(spark, sf_dir, "supplier"), SHAPE)
    return rounded(fields.select("mask_id", "x", "y", "z", (5.0 * F.tanh(_root(F.col("d2")) / 5.0)).alias("v")), 6, "v")


@query(f"""{_EDT_MANY} SELECT mask_id, count(*) FILTER (WHERE abs(d2) < 4) AS boundary, count(*) FILTER (WHERE d2 < -4) AS inside,
count(*) FILTER (WHERE d2 > 4) AS outside, count(*) FILTER (WHERE abs(d2) = 4) AS none FROM sdf GROUP BY mask_id""")
def narrow_band_counts(spark, sf_dir):
    d = _root(F.col("d2"))
    fields = transforms.distance_fields(*cohorts.masks(spark, sf_dir, "supplier"), SHAPE)
    bands = {"boundary": F.abs(d) < 2, "inside": d < -2, "outside": d > 2, "none": F.abs(d) == 2}
    return fields.groupBy("mask_id").agg(*[F.count_if(c).alias(k) for k, c in bands.items()])


def _dct_sql(order: int, value: str) -> str:
    return f"""{_EDT}, b AS (SELECT k::INT AS k, n::INT AS n, cos(pi() * (2 * n + 1) * k / 32) * CASE WHEN k = 0 THEN sqrt(1e0 / 16) ELSE sqrt(2e0 / 16) END AS w FROM range({order}) gk(k), range(16) gn(n)),
c1 AS (SELECT mask_id, k AS i, y, z, sum(w * {value}) AS v FROM sdf JOIN b ON n = x GROUP BY ALL),
c2 AS (SELECT mask_id, i, k AS j, z, sum(w * v) AS v FROM c1 JOIN b ON n = y GROUP BY ALL),
c3 AS (SELECT mask_id, i, j, k, sum(w * v) AS v FROM c2 JOIN b ON n = z GROUP BY ALL)"""


_TANH, _PLAIN = "5e0 * tanh(sign(d2) * sqrt(abs(d2)) / 5e0)", "sign(d2) * sqrt(abs(d2))"


@query(f"{_dct_sql(5, _TANH)} SELECT mask_id, i, j, k, {r('v', 4)} AS value FROM c3 WHERE i*i + j*j + k*k <= 25")
def dct_features(spark, sf_dir):
    features = transforms.dct_features(*cohorts.masks(spark, sf_dir, "nation"), SHAPE, order=5)
    return rounded(transforms.long_features(features, 5), 4, "value")


@query(f"{_dct_sql(4, _PLAIN)} SELECT mask_id, i, j, k, {r('v', 4)} AS value FROM c3")
def dct_cube_features(spark, sf_dir):
    features = transforms.dct_features(*cohorts.masks(spark, sf_dir, "nation"), SHAPE, order=4, sphere=False, saturation=None)
    return rounded(transforms.long_features(features, 4, sphere=False), 4, "value")


def _back_sql(where: str) -> str:
    return f""", k3 AS (SELECT * FROM c3 WHERE {where}), r1 AS (SELECT mask_id, n AS x, j, k3.k, sum(w * v) AS v FROM k3 JOIN b ON b.k = i GROUP BY ALL),
r2 AS (SELECT mask_id, x, n AS y, r1.k, sum(w * v) AS v FROM r1 JOIN b ON b.k = j GROUP BY ALL),
r3 AS (SELECT mask_id, x, y, n AS z, sum(w * v) AS v FROM r2 JOIN b ON b.k = r2.k GROUP BY ALL)"""


@query(f"{_dct_sql(6, _TANH)}{_back_sql('i*i + j*j + k*k <= 36')} SELECT mask_id, x, y, z FROM r3 WHERE v < 0")
def dct_smooth_mask(spark, sf_dir):
    return transforms.smoothed(*cohorts.masks(spark, sf_dir, "nation"), SHAPE, order=6)


@query(f"{_dct_sql(4, _PLAIN)}{_back_sql('true')} SELECT mask_id, x, y, z FROM r3 WHERE v < 0")
def dct_cube_smooth_mask(spark, sf_dir):
    return transforms.smoothed(*cohorts.masks(spark, sf_dir, "nation"), SHAPE, order=4, sphere=False, saturation=None)


@query(f"""{_MANY} SELECT mask_id, i::INT AS i, j::INT AS j, k::INT AS k, ((i * 6 + j) * 6 + k)::INT AS n FROM par, range(6) gi(i), range(6) gj(j), range(6) gk(k)
WHERE i*i + j*j + k*k <= a * a""")
def spectral_mask(spark, sf_dir):
    """The cosine coefficients of a cube of 6 that a mask keeps whose radius is its first half axis."""
    rows = cohorts.ellipsoids(spark, sf_dir, "supplier").select("mask_id", "a")
    return transforms.with_coefficients(rows, 6, F.col("a")).drop("a")


def _terms_sql(order: int) -> str:
    return f"(SELECT i::INT AS i, j::INT AS j, k::INT AS k, (row_number() OVER (ORDER BY i, j, k) - 1)::INT AS idx FROM range({order + 1}) gi(i), range({order + 1}) gj(j), range({order + 1}) gk(k) WHERE i + j + k <= {order})"


def _centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mask_id, u, v, w: the masks' centres and sizes between -1 and 1."""
    return cohorts.ellipsoids(spark, sf_dir, "supplier").select("mask_id", ((F.col("cx") - 8) / 9).alias("u"), ((F.col("cz") - 8) / 9).alias("v"), ((F.col("a") - 8) / 9).alias("w"))


_CENTRES = f"{_MANY}, pos AS (SELECT mask_id, (cx - 8) / 9e0 AS u, (cz - 8) / 9e0 AS v, (a - 8) / 9e0 AS w FROM par)"


@query(f"{_CENTRES} SELECT mask_id, i, j, k, idx, {r('pow(w, i) * pow(v, j) * pow(u, k)', 9)} AS value FROM pos, {_terms_sql(8)}")
def monomial_basis(spark, sf_dir):
    """The terms of order 8 and their values at each mask's centre; the first exponent is that of the last axis."""
    rows = transforms.with_terms(_centres(spark, sf_dir), 8)
    return rounded(rows.select("mask_id", "i", "j", "k", "idx", (F.pow("w", "i") * F.pow("v", "j") * F.pow("u", "k")).alias("value")), 9, "value")


@query(f"{_CENTRES} SELECT mask_id, i, j, k, idx, {r('cos(i * acos(w)) * cos(j * acos(v)) * cos(k * acos(u))')} AS value FROM pos, {_terms_sql(6)}")
def cheby_basis(spark, sf_dir):
    """The terms of order 6 and their values at each mask's centre, by the recurrence."""
    at = _centres(spark, sf_dir).select("mask_id", *[transforms.chebyshev_values(F.col(c), 6).alias(c) for c in "uvw"])
    value = F.col("w")[F.col("i")] * F.col("v")[F.col("j")] * F.col("u")[F.col("k")]
    return rounded(transforms.with_terms(at, 6).select("mask_id", "i", "j", "k", "idx", value.alias("value")), 6, "value")


def _fit(spark: SparkSession, sf_dir: str, order: int, cheby: bool, alpha: float) -> DataFrame:
    meta, voxel = cohorts.masks(spark, sf_dir, "nation")
    return transforms.polynomial_features(meta, voxel, SHAPE, order, cheby, alpha)


@query(f"{_FEW} SELECT DISTINCT mask_id, 816 AS n, 8e0 AS scale FROM voxel")
def cheby_fit(spark, sf_dir):
    return _fit(spark, sf_dir, 15, True, 1e-3).select("mask_id", F.size("features").alias("n"), "scale")


@query(f"{_FEW} SELECT mask_id, 84 AS n, {r('greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) / 2 * 1.1e0')} AS scale FROM voxel GROUP BY mask_id")
def mono_fit(spark, sf_dir):
    return rounded(_fit(spark, sf_dir, 6, False, 1e-4).select("mask_id", F.size("features").alias("n"), "scale"), 6, "scale")


# Cohort statistics

_LONG = "WITH f AS (SELECT vec_id, unnest(range(0, len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"


@query(f"{_LONG} SELECT i, {r('avg(v)')} AS mean FROM f GROUP BY i")
def feature_mean(spark, sf_dir):
    return rounded(cohort_model.means(vectors(spark, sf_dir)), 6, "mean")


@query(f"{_LONG} SELECT a.i AS i, b.i AS j, {r('covar_samp(a.v, b.v)')} AS cov FROM f a JOIN f b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL")
def feature_covariance(spark, sf_dir):
    return rounded(cohort_model.covariances(vectors(spark, sf_dir)), 6, "cov")


@query(f"{_LONG} SELECT a.i AS i, b.i AS j, {r('covar_samp(a.v, b.v)')} AS cov FROM f a JOIN f b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL")
def feature_covariance_shifted(spark, sf_dir):
    """Features a million away from zero have the same covariance."""
    far = vectors(spark, sf_dir).withColumn("features", F.transform("features", lambda x: x + 1e6))
    return rounded(cohort_model.covariances(far), 6, "cov")


@query(f"""{_LONG}, w AS (SELECT vec_id // 50 AS id, (vec_id % 50) * 64 + i AS i, v FROM f WHERE vec_id < (SELECT count(*) // 50 * 50 FROM embeddings)),
c AS (SELECT id, i, v - avg(v) OVER (PARTITION BY i) AS v FROM w), g AS (SELECT a.id AS p, b.id AS q, sum(a.v * b.v) AS g FROM c a JOIN c b ON a.i = b.i GROUP BY ALL)
SELECT {r('sum(CASE WHEN p = q THEN g END) / (count(DISTINCT p) - 1)')} AS first, {r('sum(g * g) / pow(count(DISTINCT p) - 1, 2)')} AS second FROM g""")
def pca_wide_moments(spark, sf_dir):
    """Embeddings, 50 in a row, are fewer rows than features: the sums of the variances and of their squares."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.filter(F.col("vec_id") < rows.count() // 50 * 50)
    wide = rows.groupBy(F.floor(F.col("vec_id") / 50).alias("mask_id")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("all"))
    wide = wide.select("mask_id", F.flatten(F.transform("all", lambda x: x["embedding"].cast("array<double>"))).alias("features"))
    model = cohort_model.fit(wide, dual=True).table(wide)
    return rounded(model.agg(F.sum("variance").alias("first"), F.sum(F.col("variance") * F.col("variance")).alias("second")), 6, "first", "second")


@query(f"{_LONG} SELECT {r('sum(s)')} AS variance, 1e0 AS ratio FROM (SELECT var_samp(v) AS s FROM f GROUP BY i)")
def pca_variance_total(spark, sf_dir):
    features = vectors(spark, sf_dir)
    model = cohort_model.fit(features).table(features)
    return rounded(model.agg(F.sum("variance").alias("variance"), F.sum("variance_ratio").alias("ratio")), 6, "variance", "ratio")


@query("SELECT a.k::INT AS k, b.k::INT AS l, CASE WHEN a.k = b.k THEN 1e0 ELSE 0e0 END AS product FROM range(64) a(k), range(64) b(k) WHERE a.k <= b.k")
def pca_orthonormality(spark, sf_dir):
    features = vectors(spark, sf_dir)
    model = cohort_model.fit(features).table(features)  # at most 64 rows
    other = model.select(F.col("k").alias("l"), F.col("component").alias("other"))
    both = model.join(other, F.col("k") <= F.col("l")).select("k", "l", linear.dot(F.col("component"), F.col("other")).alias("product"))
    return rounded(both, 6, "product")


@query("SELECT k::INT AS k, 0e0 AS mean, 1e0 AS variance FROM range(64) g(k)")
def pca_scores_unit_variance(spark, sf_dir):
    features = vectors(spark, sf_dir)
    out = cohort_model.scores(features, cohort_model.fit(features))
    long = out.select(F.posexplode("coeffs").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("mean"), F.var_samp("v").alias("variance"))
    return rounded(long, 6, "mean", "variance")


@query(f"{_LONG} SELECT vec_id AS mask_id, i, {r('v', 4)} AS v FROM f")
def pca_reconstruct(spark, sf_dir):
    features = vectors(spark, sf_dir)
    model = cohort_model.fit(features)
    back = cohort_model.reconstructed(cohort_model.scores(features, model), model)
    return rounded(back.select("mask_id", F.posexplode("features").alias("i", "v")), 4, "v")


@query(f"SELECT m::INT AS mode, s::INT AS step, {r('-2 + s * 0.4e0')} AS coeff FROM range(8) gm(m), range(11) gs(s)")
def modes_steps(spark, sf_dir):
    features = vectors(spark, sf_dir)
    out = cohort_model.mode_steps(cohort_model.fit(features, 8).table(features)).select("mode", "step", "coeff")
    return rounded(out, 6, "coeff")


@query()
def modes_voxels(spark, sf_dir):
    """Masks along the first modes of the cosine features of a cohort."""
    features = transforms.dct_features(*cohorts.masks(spark, sf_dir, "nation"), SHAPE, order=4)
    model = cohort_model.fit(features, 3)
    return cohort_model.modes(model.table(features), model.mean, lambda v: transforms.mask_of(v, SHAPE, 4, True), n_components=3, n_coeffs=5)


@query()
def kmeans_labels(spark, sf_dir):
    return cohort_model.clusters(vectors(spark, sf_dir), k=10)


@query(f"""SELECT a.vec_id AS id_a, b.vec_id AS id_b, {r('list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e))', 4)} AS cosine
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON a.vec_id < b.vec_id""")
def cosine_similarity(spark, sf_dir):
    return rounded(cohort_model.cosine_pairs(vectors(spark, sf_dir)), 4, "cosine")


# Harmonics


@query(f"""{_FEW}, m AS (SELECT mask_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM voxel GROUP BY mask_id),
d AS (SELECT mask_id, x - mx AS dx, y - my AS dy, z - mz AS dz, sqrt((x-mx)*(x-mx) + (y-my)*(y-my) + (z-mz)*(z-mz)) AS r FROM voxel JOIN m USING (mask_id))
SELECT mask_id, count(*) AS n, {r('max(r)')} AS longest FROM d WHERE r > 0 GROUP BY mask_id""")
def radius_map(spark, sf_dir):
    """The farthest voxel stays in the map; every cell has one of the voxels beside the centroid's own."""
    voxel = cohorts.masks(spark, sf_dir, "nation")[1]
    longest = harmonics.radius_map(voxel).groupBy("mask_id").agg(F.max("r").alias("longest"))
    middle = voxel.groupBy("mask_id").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in "xyz"])
    centred = voxel.join(middle, "mask_id").filter("x = m_x and y = m_y and z = m_z").groupBy("mask_id").agg(F.count("*").alias("at_centre"))
    out = middle.join(centred, "mask_id", "left").join(longest, "mask_id").select("mask_id", (F.col("n") - F.coalesce("at_centre", F.lit(0))).alias("n"), "longest")
    return rounded(out, 6, "longest")


@query(f"{_LONG} SELECT vec_id AS mask_id, floor(sqrt(i))::INT AS l, {r('sqrt(sum(v * v))')} AS power FROM f GROUP BY ALL")
def power_spectrum(spark, sf_dir):
    """Embeddings read as the harmonic coefficients of degrees 0 to 7."""
    long = vectors(spark, sf_dir).select("mask_id", F.posexplode("features").alias("i", "c"))
    return rounded(harmonics.power_spectrum(long.select("mask_id", F.floor(F.sqrt("i")).cast("int").alias("l"), "c")), 6, "power")


@query("""WITH s AS (SELECT s_suppkey, (s_suppkey % 11) / 10e0 AS r FROM supplier) SELECT s_suppkey, 1e0 AS r00, round(r, 9) + 0e0 AS r11, round(2 * r * r - 1, 9) + 0e0 AS r20,
round(r * r, 9) + 0e0 AS r22, round(3 * r * r * r - 2 * r, 9) + 0e0 AS r31, round(6 * r * r * r * r - 6 * r * r + 1, 9) + 0e0 AS r40 FROM s""")
def radial_poly(spark, sf_dir):
    radius = (F.col("s_suppkey") % 11) / 10.0
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", radius.alias("r"))
    terms = {f"r{n}{m}": harmonics.radial_polynomial(n, m, F.col("r")) for n, m in ((0, 0), (1, 1), (2, 0), (2, 2), (3, 1), (4, 0))}
    return rounded(rows.select("s_suppkey", *[c.alias(k) for k, c in terms.items()]), 9, *terms)


_OFF_CENTRE = """, m AS (SELECT mask_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM voxel GROUP BY mask_id),
d AS (SELECT mask_id, x - mx AS dx, y - my AS dy, z - mz AS dz FROM voxel JOIN m USING (mask_id)),
u AS (SELECT mask_id, dz, sqrt(dx*dx + dy*dy + dz*dz) AS r, max(sqrt(dx*dx + dy*dy + dz*dz)) OVER (PARTITION BY mask_id) AS most FROM d)"""


@query(f"""{_FEW}{_OFF_CENTRE} SELECT mask_id, {r('sum(sqrt(1 / (4 * pi())))', 4)} AS z000, {r('sum((2 * (r / most) * (r / most) - 1) * sqrt(1 / (4 * pi())))', 4)} AS z200,
{r('sum((r / most) * (r / most) * sqrt(5 / (16 * pi())) * (3 * (dz / r) * (dz / r) - 1))', 4)} AS z220 FROM u WHERE r > 1e-9 GROUP BY mask_id""")
def zernike_moments(spark, sf_dir):
    """The moments (n, l, m) = (0, 0, 0), (2, 0, 0) and (2, 2, 0)."""
    out = harmonics.zernike_moments(*cohorts.masks(spark, sf_dir, "nation"), SHAPE, 3).filter("m = 0")
    pick = [F.sum(F.when((F.col("n") == n) & (F.col("l") == l), F.col("re"))).alias(f"z{n}{l}0") for n, l in ((0, 0), (2, 0), (2, 2))]
    return rounded(out.groupBy("mask_id").agg(*pick), 4, "z000", "z200", "z220")


@query(f"{_FEW} SELECT DISTINCT mask_id, 81::BIGINT AS n, true AS close FROM voxel")
def sh_coefficients(spark, sf_dir):
    """The mean radius in the coefficients of degree 0 lies between the shortest and the longest half axis."""
    out = harmonics.harmonic_coefficients(*cohorts.masks(spark, sf_dir, "nation"), SHAPE, lmax=8)
    mean = F.max(F.when(F.col("l") == 0, F.col("c") * F.col("extent") / np.sqrt(4 * np.pi)))
    return out.groupBy("mask_id").agg(F.count("*").alias("n"), mean.between(1.0, 8.0).alias("close"))


# Meshes of masks

_TETS = ", ".join(f"({n}, {c[0]}, {c[1]}, {c[2]})" for n, tet in enumerate(meshes.tetrahedra()) for c in tet)


@query(f"""{_MANY}, t(n, i, j, k) AS (VALUES {_TETS}), h AS (SELECT mask_id, x - i AS cx, y - j AS cy, z - k AS cz, n, count(*) AS inside FROM voxel, t GROUP BY ALL)
SELECT mask_id, {r('sum(CASE inside WHEN 1 THEN 0.125e0 WHEN 2 THEN 0.5e0 WHEN 3 THEN 0.875e0 ELSE 1e0 END) / 6')} AS volume, 2::BIGINT AS euler, 0::BIGINT AS open_edges FROM h GROUP BY mask_id""")
def mask_surface_mesh(spark, sf_dir):
    """The volume within the surface is that of the tetrahedra's parts inside; an ellipsoid's surface is closed and in one piece."""
    voxel = cohorts.masks(spark, sf_dir, "supplier")[1]
    out = meshes.measures(meshes.surface_mesh(voxel)[0], meshes.surface_corners(voxel))
    return rounded(out.select("mask_id", "volume", "euler", "open_edges"), 6, "volume")


@query(f"{_MANY} SELECT mask_id, x, y, z FROM voxel")
def mesh_to_mask(spark, sf_dir):
    """The cells within the masks' surfaces are the masks again."""
    voxel = cohorts.masks(spark, sf_dir, "supplier")[1]
    return meshes.inside_mesh(meshes.surface_mesh(voxel)[0], meshes.surface_corners(voxel), SHAPE)


# Meshes, one unit sphere for each nation, of two subdivisions


def _spheres(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v, f = meshes.icosphere(2)
    ids = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("mask_id"))
    points = F.array(*[F.struct(F.lit(i).alias("vid"), *[F.lit(float(x)).alias(c) for c, x in zip("xyz", p, strict=True)]) for i, p in enumerate(v)])
    corners = F.array(*[F.struct(F.lit(n).alias("fid"), *[F.lit(int(x)).alias(c) for c, x in zip("ijk", t, strict=True)]) for n, t in enumerate(f)])
    return tuple(ids.select("mask_id", F.explode(a).alias("a")).select("mask_id", "a.*") for a in (points, corners))


_NATIONS = "(SELECT n_nationkey::BIGINT AS mask_id FROM nation)"


@query(f"SELECT mask_id, 162 + 2 * 480 AS entries, 0e0 AS row_sum, 0e0 AS skew FROM {_NATIONS}")
def cot_laplacian(spark, sf_dir):
    """Its rows add to 0 and it is symmetric, with an entry for each vertex and each end of each of 480 edges."""
    w = meshes.cotangent_laplacian(*_spheres(spark, sf_dir))
    rows = w.groupBy("mask_id", "i").agg(F.sum("w").alias("s")).groupBy("mask_id").agg(F.max(F.abs("s")).alias("row_sum"))
    both = w.select("mask_id", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), (F.col("w") * F.signum(F.col("i") - F.col("j"))).alias("d"))
    skew = both.groupBy("mask_id", "a", "b").agg(F.abs(F.sum("d")).alias("d")).groupBy("mask_id").agg(F.max("d").alias("skew"))
    out = w.groupBy("mask_id").agg(F.count("*").cast("int").alias("entries")).join(rows, "mask_id").join(skew, "mask_id")
    return rounded(out, 6, "row_sum", "skew")


@query(f"SELECT mask_id, 0e0 AS first, true AS second, true AS third FROM {_NATIONS}")
def lb_spectrum(spark, sf_dir):
    """On a sphere the eigenvalues come in groups of 1, 3 and 5, as l (l + 1)."""
    out = meshes.spectrum(meshes.cotangent_laplacian(*_spheres(spark, sf_dir)), 9)
    e = lambda i: F.col("eigenvalues")[i]
    out = out.select("mask_id", e(0).alias("first"), (e(3) / e(1) < 1.05).alias("second"), (e(4) / e(1)).between(2.7, 3.3).alias("third"))
    return rounded(out, 6, "first")


@query("""WITH c AS (SELECT vec_id, k, embedding[3 * k + 1]::DOUBLE AS cx, embedding[3 * k + 2]::DOUBLE AS cy, embedding[3 * k + 3]::DOUBLE AS cz FROM embeddings, range(21) g(k))
SELECT vec_id AS mask_id, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cx * cx + cy * cy + cz * cz DESC, k) AS n FROM c) WHERE n <= 5""")
def lb_top_modes(spark, sf_dir):
    """Embeddings read as 21 modes of three coefficients: the strongest 20 %."""
    triples = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.slice("features", 3 * k + 1, 3))
    rows = vectors(spark, sf_dir).select("mask_id", F.posexplode(triples).alias("k", "c")).select("mask_id", "k", *[F.col("c")[i].alias(f"c{a}") for i, a in enumerate("xyz")])
    return meshes.top_modes(rows, 20).select("mask_id", "k")


@query(f"SELECT mask_id, 162::BIGINT AS n, 1e0 AS least, 1e0 AS most, 0e0 AS middle FROM {_NATIONS}")
def vertex_inflation_step(spark, sf_dir):
    """All vertices are on the unit sphere about the middle."""
    out = meshes.inflation_step(*_spheres(spark, sf_dir)).withColumn("r", F.sqrt(F.expr("x * x + y * y + z * z")))
    out = out.groupBy("mask_id").agg(F.count("*").alias("n"), F.min("r").alias("least"), F.max("r").alias("most"), F.avg("x").alias("middle"))
    return rounded(out, 6, "least", "most", "middle")
