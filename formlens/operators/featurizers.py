"""Features of a cohort by name: encoders of masks and decoders of features, with the parameters that were used beside them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from inspect import signature

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import harmonics, inverse, meshes, transforms

Shape = tuple[int, int, int]


def _dct(meta: DataFrame, voxel: DataFrame, shape: Shape, order: int = 16, sphere: bool = True, saturation: float | None = 5.0) -> DataFrame:
    return transforms.dct_features(meta, voxel, shape, order, sphere, saturation)


def _dct_back(features: DataFrame, shape: Shape, order: int = 16, sphere: bool = True, saturation: float | None = 5.0) -> DataFrame:
    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                x, y, z = np.nonzero(transforms.mask_of(np.asarray(row.features), shape, order, sphere))
                yield pd.DataFrame({"mask_id": row.mask_id, "x": x, "y": y, "z": z})

    return features.filter("features is not null").select("mask_id", "features").mapInPandas(cells, "mask_id long, x int, y int, z int")


def _cheby(meta: DataFrame, voxel: DataFrame, shape: Shape, order: int = 15, alpha: float = 1e-3) -> DataFrame:
    return transforms.polynomial_features(meta, voxel, shape, order, True, alpha).select("mask_id", "features")


def _cheby_back(features: DataFrame, shape: Shape, order: int = 15, alpha: float = 1e-3) -> DataFrame:
    return inverse.chebyshev_voxels(features, shape, order)


def _points(meta: DataFrame, voxel: DataFrame, shape: Shape, subdivisions: int = 3, iterations: int = 80) -> DataFrame:
    points = inverse.point_distribution(*meshes.surface_mesh(voxel), subdivisions, iterations)
    rows = points.groupBy("mask_id").agg(F.sort_array(F.collect_list(F.struct("vid", "x", "y", "z"))).alias("p"))  # as many as the template has
    return rows.select("mask_id", F.flatten(F.transform("p", lambda p: F.array(p["x"], p["y"], p["z"]))).alias("features"))


def _points_back(features: DataFrame, shape: Shape, subdivisions: int = 3, iterations: int = 80, samples: int = 50_000) -> DataFrame:
    each = F.expr("transform(sequence(0, cast(size(features) / 3 as int) - 1), n -> slice(features, 3 * n + 1, 3))")
    rows = features.select("mask_id", F.posexplode(each).alias("vid", "p"))
    return inverse.point_voxels(rows.select("mask_id", F.col("vid").cast("long").alias("vid"), *[F.col("p")[i].alias(c) for i, c in enumerate("xyz")]), shape, subdivisions, samples)


def _harmonics(meta: DataFrame, voxel: DataFrame, shape: Shape, lmax: int = 15, fitted: bool = False) -> DataFrame:
    """Centroid, extent and the coefficients by degree and order."""
    found = harmonics.harmonic_coefficients(meta, voxel, shape, lmax) if fitted else harmonics.expanded_coefficients(voxel, lmax)
    rows = found.groupBy("mask_id").agg(F.sort_array(F.collect_list(F.struct("l", "m", "c"))).alias("c"), F.first("centroid").alias("centroid"), F.first("extent").alias("extent"))  # (lmax + 1)**2 of them
    return rows.select("mask_id", F.concat("centroid", F.array("extent"), F.col("c")["c"]).alias("features"))


def _harmonics_back(features: DataFrame, shape: Shape, lmax: int = 15, fitted: bool = False) -> DataFrame:
    rows = features.select("mask_id", F.slice("features", 1, 3).alias("centroid"), F.col("features")[3].alias("extent"), F.posexplode(F.expr("slice(features, 5, size(features) - 4)")).alias("at", "c"))
    degree = F.floor(F.sqrt(F.col("at").cast("double"))).cast("int")
    rows = rows.select("mask_id", "centroid", "extent", degree.alias("l"), (F.col("at") - degree * degree - degree).cast("int").alias("m"), "c")
    return inverse.harmonic_voxels(rows, shape, lmax)


#: Encoder (meta, voxel, shape, parameters) to mask_id, features, and decoder (features, shape, parameters) to voxels.
FEATURIZERS: dict[str, tuple[Callable[..., DataFrame], Callable[..., DataFrame]]] = {
    "dct": (_dct, _dct_back), "cheby": (_cheby, _cheby_back), "points": (_points, _points_back), "harmonics": (_harmonics, _harmonics_back)}


def encode(name: str, meta: DataFrame, voxel: DataFrame, shape: Shape, **parameters: object) -> DataFrame:
    """mask_id, label, features (float), original_shape, featurizer, parameters (json, defaults included): a row for each mask of meta.

    Features are null where a mask has none, as an empty one. The rows can be written as they are and decoded later.
    """
    encoder, _ = FEATURIZERS[name]
    used = {k: v.default for k, v in signature(encoder).parameters.items() if k not in ("meta", "voxel", "shape")} | parameters
    found = encoder(meta, voxel, shape, **parameters).select("mask_id", F.col("features").cast("array<float>").alias("features"))
    label = F.col("label") if "label" in meta.columns else F.lit(None).cast("string").alias("label")
    return meta.select("mask_id", label).join(found, "mask_id", "left").select(
        "mask_id", "label", "features", F.array(*[F.lit(n) for n in shape]).alias("original_shape"), F.lit(name).alias("featurizer"), F.lit(json.dumps(used, sort_keys=True)).alias("parameters"))


def decode(name: str, features: DataFrame, shape: Shape, **parameters: object) -> DataFrame:
    """The masks (mask_id, x, y, z) of features that encode or a model made with the same parameters."""
    rows = features.filter("features is not null").select("mask_id", F.col("features").cast("array<double>").alias("features"))
    return FEATURIZERS[name][1](rows, shape, **parameters)
