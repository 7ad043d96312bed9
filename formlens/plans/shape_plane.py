"""Cohort models in two dimensions, where components, scores, modes and clusters have closed forms: a mask's features are its volume and its spread along x."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohort_model
from ..sources import cohorts
from .catalogue import query, r, rounded

_MANY = cohorts.oracle_cte("supplier")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cohorts.masks(spark, sf_dir, "supplier")[1].groupBy("mask_id").agg((F.count("*") / 100).alias("u"), F.var_pop("x").alias("v"))
    return found.select("mask_id", F.array("u", "v").alias("features"))


# The covariance (a, b; b, d) has the eigenvalues e and, of the two forms of their vectors, the longer one (p, q) is taken.
_MODEL = f"""{_MANY}, f AS (SELECT mask_id, count(*) / 100e0 AS u, var_pop(x) AS v FROM voxel GROUP BY mask_id),
c AS (SELECT avg(u) AS mu, avg(v) AS mv, var_samp(u) AS a, covar_samp(u, v) AS b, var_samp(v) AS d FROM f),
e AS (SELECT *, (a + d) / 2 + s * sqrt(pow((a - d) / 2, 2) + b * b) AS e FROM c, (VALUES (0, 1), (1, -1)) t(k, s)),
w AS (SELECT *, CASE WHEN abs(e - d) > abs(e - a) THEN e - d ELSE b END AS p, CASE WHEN abs(e - d) > abs(e - a) THEN b ELSE e - a END AS q FROM e),
m AS (SELECT k, mu, mv, a, d, e, p / n AS p, q / n AS q FROM (SELECT *, sqrt(p * p + q * q) * CASE WHEN abs(q) > abs(p) THEN sign(q) ELSE sign(p) END AS n FROM w))"""


@query(f"{_MODEL} SELECT k, {r('p')} AS p, {r('q')} AS q, {r('e')} AS variance, {r('e / (a + d)')} AS ratio FROM m")
def plane_components(spark, sf_dir):
    features = _features(spark, sf_dir)
    model = cohort_model.fit(features).table(features)
    out = model.select("k", F.col("component")[0].alias("p"), F.col("component")[1].alias("q"), "variance", F.col("variance_ratio").alias("ratio"))
    return rounded(out, 6, "p", "q", "variance", "ratio")


@query(f"{_MODEL} SELECT mask_id, k, {r('((u - mu) * p + (v - mv) * q) / sqrt(e)')} AS coeff FROM f, m")
def plane_scores(spark, sf_dir):
    features = _features(spark, sf_dir)
    out = cohort_model.scores(features, cohort_model.fit(features))
    return rounded(out.select("mask_id", F.posexplode("coeffs").alias("k", "coeff")), 6, "coeff")


@query(f"{_MODEL} SELECT mask_id, {r('mu + ((u - mu) * p + (v - mv) * q) * p')} AS u, {r('mv + ((u - mu) * p + (v - mv) * q) * q')} AS v FROM f, m WHERE k = 0")
def plane_reconstruct(spark, sf_dir):
    """From the first score alone: the features' foot on the first axis."""
    features = _features(spark, sf_dir)
    model = cohort_model.fit(features, 1)
    back = cohort_model.reconstructed(cohort_model.scores(features, model), model)
    return rounded(back.select("mask_id", *[F.col("features")[i].alias(c) for i, c in enumerate("uv")]), 6, "u", "v")


def _box(v: np.ndarray) -> np.ndarray:
    """A mask as high and wide as the features say."""
    x, y = np.indices((16, 16))
    return ((x <= v[0]) & (y <= v[1]))[:, :, None]


@query(f"""{_MODEL} SELECT k AS mode, step::INT AS step, {r('-2 + step * 0.4e0')} AS coeff, x::INT AS x, y::INT AS y, 0 AS z FROM m, range(11) gs(step), range(16) gx(x), range(16) gy(y)
WHERE x <= mu + (-2 + step * 0.4e0) * sqrt(e) * p AND y <= mv + (-2 + step * 0.4e0) * sqrt(e) * q""")
def plane_modes(spark, sf_dir):
    """The masks along both modes, of a decoder that draws boxes."""
    features = _features(spark, sf_dir)
    model = cohort_model.fit(features)
    return rounded(cohort_model.modes(model.table(features), model.mean, _box), 6, "coeff")


@query(f"""{_MANY}, f AS (SELECT mask_id, var_pop(x) AS v FROM voxel GROUP BY mask_id),
p AS (SELECT v, n, count(*) OVER () AS splits, sum(n) OVER w AS n1, sum(s) OVER w AS s1, sum(n) OVER () - sum(n) OVER w AS n2, sum(s) OVER () - sum(s) OVER w AS s2
  FROM (SELECT v, count(*) AS n, sum(v) AS s FROM (SELECT round(v, 9) AS v FROM f) GROUP BY v) WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)),
b AS (SELECT arg_max(v, s1 * s1 / n1 + s2 * s2 / n2) AS cut FROM p WHERE n2 > 0),
t AS (SELECT mask_id, round(v, 9) <= cut AS low FROM f, b)
SELECT mask_id, CASE WHEN low = (SELECT arg_min(low, mask_id) FROM t) THEN 0 ELSE 1 END AS cluster FROM t""")
def kmeans_spread(spark, sf_dir):
    """Two clusters of one feature, the spread along x: the best of all places to cut the sorted values."""
    features = _features(spark, sf_dir).select("mask_id", F.slice("features", 2, 1).alias("features"))
    return cohort_model.clusters(features, k=2)
