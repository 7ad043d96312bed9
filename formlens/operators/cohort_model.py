"""Statistics of feature vectors: mean, covariance, principal components, scores, modes and clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wide_pca

#: A matrix of more rows isn't brought to the driver: the covariance of the features or, where these are more, the products of the masks.
MOST = 4096
#: Components that are looked for where both are more and no number is given.
WIDE = 64
#: Features of a slice in the dual fit.
SLICE = 4096


@dataclass(frozen=True)
class Pca:
    mean: np.ndarray
    components: np.ndarray  # (K, F), the largest entry of each positive
    variance: np.ndarray
    ratio: np.ndarray

    def table(self, features: DataFrame) -> DataFrame:
        rows = [(k, float(v), float(r), c.tolist()) for k, (v, r, c) in enumerate(zip(self.variance, self.ratio, self.components, strict=True))]
        return features.sparkSession.createDataFrame(rows, "k int, variance double, variance_ratio double, component array<double>")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def means(features: DataFrame) -> DataFrame:
    """i, mean."""
    return features.select(F.posexplode("features").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("mean"))


def _mean(features: DataFrame) -> np.ndarray:
    rows = means(features).toPandas().sort_values("i")  # a number for each feature
    return rows["mean"].to_numpy(np.float64)


def sums(features: DataFrame, shift: np.ndarray) -> DataFrame:
    """i, j (i <= j), n, s_i, s_j, s_ij: sums of the features less `shift` over all rows, added up within each task before they are shuffled."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = 0, np.zeros(len(shift)), np.zeros((len(shift),) * 2)
        for frame in frames:
            if len(frame):
                x = _matrix(frame["features"]) - shift
                n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        if n:
            i, j = np.triu_indices(len(s))
            yield pd.DataFrame({"i": i, "j": j, "n": n, "s_i": s[i], "s_j": s[j], "s_ij": ss[i, j]})

    parts = features.select("features").mapInPandas(add, "i int, j int, n long, s_i double, s_j double, s_ij double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "s_i", "s_j", "s_ij")])


def covariances(features: DataFrame) -> DataFrame:
    """i, j (i <= j), cov: the sample covariance, of features less their means, so large ones lose no digits."""
    return sums(features, _mean(features)).select("i", "j", ((F.col("s_ij") - F.col("s_i") * F.col("s_j") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))).alias("cov"))


def fit(features: DataFrame, k: int | None = None, dual: bool | None = None) -> Pca:
    """Principal components of features (mask_id, features), at most k or min(N, F).

    By the eigenvectors of the covariance of the features or, if these are more than MOST (or dual), by those of the
    products of the masks. If both are more, the k (or WIDE) leading ones are found on tiles; wide_pca.fit is the same
    without bringing them to the driver.
    """
    width = features.select(F.size("features").alias("n")).first()
    if width is None:
        raise ValueError("there are no features")
    if width.n > MOST and features.count() > MOST:
        found = wide_pca.fit(features, k or WIDE)
        rows, mean = found.table().toPandas().sort_values("k"), found.mean().toPandas().sort_values("i")
        return Pca(mean["mean"].to_numpy(), np.stack(rows["component"]), found.variance, found.ratio)
    if dual or width.n > MOST:
        return _dual(features, k)
    shift = _mean(features)
    rows = sums(features, shift).toPandas()
    f, n = width.n, int(rows["n"].iloc[0])
    cov = np.zeros((f, f))
    cov[rows["i"], rows["j"]] = cov[rows["j"], rows["i"]] = (rows["s_ij"] - rows["s_i"] * rows["s_j"] / n) / max(1, n - 1)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1].T
    most = min(n, f, k or f)
    return Pca(shift, _signed(vectors[:most]), values[:most], values[:most] / max(values.sum(), 1e-300))


def _signed(components: np.ndarray) -> np.ndarray:
    """The largest entry of each is positive."""
    at = np.abs(components).argmax(1)
    return components * np.where(components[np.arange(len(components)), at] < 0, -1.0, 1.0)[:, None]


def _dual(features: DataFrame, k: int | None) -> Pca:
    """The features go to slices; each slice gives its part of the products of all masks, and then its part of each component."""
    n = features.count()
    last = F.floor((F.size("features") - 1) / SLICE)
    slices = features.select("mask_id", "features", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("slice"))
    slices = slices.select("slice", "mask_id", F.slice("features", (F.col("slice") * SLICE + 1).cast("int"), SLICE).alias("v"))

    def centred(got: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x = _matrix(got.sort_values("mask_id")["v"])
        return x.mean(0), x - x.mean(0)

    def products(got: pd.DataFrame) -> pd.DataFrame:
        _, x = centred(got)
        return pd.DataFrame({"row": np.arange(len(x)), "g": list(x @ x.T)})

    def add(got: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": got["row"].iloc[:1], "g": [np.sum(np.stack(got["g"]), 0)]})

    gram = slices.groupBy("slice").applyInPandas(products, "row int, g array<double>").groupBy("row").applyInPandas(add, "row int, g array<double>")
    gram = np.stack(gram.toPandas().sort_values("row")["g"])
    values, vectors = np.linalg.eigh(gram)
    values, vectors = np.maximum(values[::-1], 0.0) / max(1, n - 1), vectors[:, ::-1]
    most = min(n, k or n)
    most = max(1, int((values[:most] > 1e-12 * values[0]).sum()))  # others have no direction
    weights = vectors[:, :most].T / np.sqrt(np.maximum(values[:most] * max(1, n - 1), 1e-300))[:, None]

    def components(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        mean, x = centred(got)
        return pd.DataFrame({"slice": key[0], "k": np.arange(-1, most), "v": [mean, *(weights @ x)]})

    parts = slices.groupBy("slice").applyInPandas(components, "slice long, k int, v array<double>").toPandas().sort_values(["k", "slice"])
    whole = np.stack([np.concatenate(list(x["v"])) for _, x in parts.groupby("k", sort=True)])
    return Pca(whole[0], _signed(whole[1:]), values[:most], values[:most] / max(values.sum(), 1e-300))


def scores(features: DataFrame, model: Pca, least_variance: float = 1e-12) -> DataFrame:
    """mask_id, coeffs: standardised scores; null where a component has less than that part of the first one's variance."""
    use = model.variance > least_variance * max(model.variance[:1].sum(), 1e-300)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                raw = (_matrix(frame["features"]) - model.mean) @ model.components.T
                out = raw / np.sqrt(np.where(use, model.variance, 1.0))
                yield pd.DataFrame({"mask_id": frame["mask_id"], "coeffs": [[float(v) if u else None for v, u in zip(r, use, strict=True)] for r in out]})

    return features.select("mask_id", "features").mapInPandas(score, "mask_id long, coeffs array<double>")


def reconstructed(coeffs: DataFrame, model: Pca) -> DataFrame:
    """mask_id, features of standardised scores."""

    def back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                c = np.nan_to_num(np.array([np.asarray(x, np.float64) for x in frame["coeffs"]]))
                yield pd.DataFrame({"mask_id": frame["mask_id"], "features": list(c * np.sqrt(model.variance) @ model.components + model.mean)})

    return coeffs.mapInPandas(back, "mask_id long, features array<double>")


def mode_steps(components: DataFrame, n_components: int = 8, n_coeffs: int = 11, max_coeff: float = 2.0) -> DataFrame:
    """mode, step, coeff, variance, component for each component and each of n_coeffs steps from -max_coeff to max_coeff."""
    step = F.explode(F.sequence(F.lit(0), F.lit(n_coeffs - 1))).alias("step")
    coeff = (-max_coeff + F.col("step") * (2.0 * max_coeff / (n_coeffs - 1))).alias("coeff")
    return components.filter(F.col("k") < n_components).select(F.col("k").alias("mode"), step, "variance", "component").select("mode", "step", coeff, "variance", "component")


def modes(components: DataFrame, mean: np.ndarray, decode: Callable[[np.ndarray], np.ndarray], **steps: float) -> DataFrame:
    """mode, step, coeff, x, y, z: the mask that decode makes of the mean moved along each mode."""

    def voxels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                x, y, z = np.nonzero(decode(mean + r.coeff * np.sqrt(r.variance) * np.asarray(r.component)))
                yield pd.DataFrame({"mode": r.mode, "step": r.step, "coeff": r.coeff, "x": x, "y": y, "z": z})

    rows = mode_steps(components, **steps).repartition("mode", "step")
    return rows.mapInPandas(voxels, "mode int, step int, coeff double, x int, y int, z int")


def clusters(features: DataFrame, k: int = 2, seed: int = 0, n_init: int = 10) -> DataFrame:
    """mask_id, cluster: the k-means clusters of the least cost of n_init starts, numbered by their least mask_id."""
    rows = features.select("mask_id", array_to_vector("features").alias("features")).persist()
    tries = [KMeans(k=k, seed=seed + i, initSteps=2).fit(rows) for i in range(n_init)]
    best = min(tries, key=lambda m: m.summary.trainingCost)
    found = best.transform(rows).select("mask_id", F.col("prediction").alias("found"))
    order = sorted(found.groupBy("found").agg(F.min("mask_id").alias("first")).collect(), key=lambda r: r.first)  # k rows
    names = F.create_map(*[F.lit(int(x)) for i, r in enumerate(order) for x in (r.found, i)])
    out = found.select("mask_id", names[F.col("found")].alias("cluster"))
    rows.unpersist()
    return out


def cosine_pairs(features: DataFrame, block: int = 1024) -> DataFrame:
    """id_a < id_b, cosine of all pairs, by matrix products of blocks; null if a vector is zero."""
    n = max(1, -(-features.count() // block))
    own = F.pmod(F.xxhash64("mask_id"), F.lit(n)).cast("int")
    rows = features.select("mask_id", "features", own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))

    def products(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values("mask_id")
        x, ids, own = _matrix(got["features"]), got["mask_id"].to_numpy(), got["own"].to_numpy()
        norm = np.linalg.norm(x, axis=1)
        left, right = own == key[0], own == key[1]
        with np.errstate(invalid="ignore", divide="ignore"):
            cosine = x[left] @ x[right].T / np.outer(norm[left], norm[right])
        a, b = np.triu_indices(left.sum(), 1) if key[0] == key[1] else (n.ravel() for n in np.indices(cosine.shape))
        i, j = ids[left][a], ids[right][b]
        return pd.DataFrame({"id_a": np.minimum(i, j), "id_b": np.maximum(i, j), "cosine": cosine[a, b]})  # NaN becomes null

    return rows.groupBy("lo", "hi").applyInPandas(products, "id_a long, id_b long, cosine double")
