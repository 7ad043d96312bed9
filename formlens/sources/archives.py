"""Masks kept as npz archives, one array a file, as tables; and tables of masks on disk."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, mask_id (of the file's whole path) and label (its name without the ending)."""
    name = F.regexp_extract("path", r"([^/]+)\.npz$", 1)
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path)
    return rows.select(F.xxhash64("path").alias("mask_id"), name.alias("label"), "content")


def read_npz(spark: SparkSession, path: str, key: str = "mask", spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> tuple[DataFrame, DataFrame]:
    """mask_meta (mask_id, label, shape, spacing) and voxel (mask_id, x, y, z) of the archives in a folder.

    Cells other than 0 are set. An array that isn't of three axes, or a file without the key, is an error that names the
    file's label. Arrays are read in tasks, a file in one; of meta's only the header is.
    """

    def shapes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                with zipfile.ZipFile(BytesIO(row.content)) as archive:
                    if f"{key}.npy" not in archive.namelist():
                        raise KeyError(f"{row.label}: no {key}")
                    with archive.open(f"{key}.npy") as f:
                        version = np.lib.format.read_magic(f)
                        header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                        shape = header(f)[0]
                if len(shape) != 3:
                    raise ValueError(f"{row.label}: three axes expected, {len(shape)} found")
                yield pd.DataFrame({"mask_id": [row.mask_id], "label": [row.label], "shape": [list(shape)]})

    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                with np.load(BytesIO(row.content), allow_pickle=False) as archive:
                    mask = archive[key] != 0
                for x, plane in enumerate(mask):  # a plane at a time, as its rows take more room than the array
                    y, z = np.nonzero(plane)
                    if len(y):
                        yield pd.DataFrame({"mask_id": row.mask_id, "x": x, "y": y, "z": z})

    files = _files(spark, path)
    meta = files.mapInPandas(shapes, "mask_id long, label string, shape array<int>")
    voxel = files.mapInPandas(cells, "mask_id long, x int, y int, z int")
    return meta.withColumn("spacing", F.array(*[F.lit(float(s)) for s in spacing])), voxel


def write_tables(meta: DataFrame, voxel: DataFrame, path: str) -> None:
    """The two tables under path, in place of what is there; the voxels of a mask lie together, in order."""
    meta.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/meta")
    ordered = voxel.repartitionByRange("mask_id", "x").sortWithinPartitions("mask_id", "x", "y", "z")
    ordered.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/voxel")


def read_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/meta"), spark.read.parquet(f"{path}/voxel")
