"""Cohorts of masks derived from the driver's tables, each row of a table one ellipsoid on a 16-voxel grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRID = 16
#: The key and the number that shape an ellipsoid, by table.
COLUMNS = {"supplier": ("s_suppkey", "s_nationkey"), "nation": ("n_nationkey", "n_regionkey")}


def ellipsoids(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """mask_id, label, side, half axes a, b, c and centre cx, cy, cz for each row of the table."""
    key, number = COLUMNS[table]
    k, n = F.col(key).cast("long"), F.col(number)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(
        k.alias("mask_id"), F.concat(F.lit("group"), (n % 5).cast("string")).alias("label"), F.when(k % 2 == 1, "left").otherwise("right").alias("side"),
        (3 + k % 4).cast("int").alias("a"), (3 + n % 3).cast("int").alias("b"), (3 + F.floor(k / 4) % 4).cast("int").alias("c"),
        (6 + k % 3).cast("int").alias("cx"), F.lit(8).alias("cy"), (7 + n % 2).cast("int").alias("cz"))


def dealt(rows: DataFrame) -> DataFrame:
    """rows by mask over as many tasks as a shuffle has: a table of keys is one small file, the cells made of it are not."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "mask_id")


def each(rows: DataFrame, name: str, n: int) -> DataFrame:
    """Each row with the whole numbers below n as column name.

    By a join with a range: Spark takes a table after an explode to be as small as before, and then broadcasts it where
    it is joined; the size of a join it takes to be the product, so only what is counted as small is broadcast.
    """
    return rows.crossJoin(F.broadcast(rows.sparkSession.range(n).select(F.col("id").cast("int").alias(name))))


def masks(spark: SparkSession, sf_dir: str, table: str) -> tuple[DataFrame, DataFrame]:
    """mask_meta (mask_id, label, side) and voxel (mask_id, x, y, z)."""
    shapes = ellipsoids(spark, sf_dir, table)
    cells = dealt(shapes)
    for c, r in zip("xyz", "abc", strict=True):
        cells = each(cells, c, GRID).filter(F.col(c).between(F.col(f"c{c}") - F.col(r), F.col(f"c{c}") + F.col(r)))
    inside = F.expr("(x-cx)*(x-cx)*b*b*c*c + (y-cy)*(y-cy)*a*a*c*c + (z-cz)*(z-cz)*a*a*b*b <= a*a*b*b*c*c")
    return shapes.select("mask_id", "label", "side"), cells.filter(inside).select("mask_id", "x", "y", "z")


def oracle_cte(table: str) -> str:
    """The same as CTEs par and voxel, by testing all cells of the grid."""
    k, n = COLUMNS[table]
    return f"""WITH par AS (SELECT {k}::BIGINT AS mask_id, 'group' || ({n} % 5)::VARCHAR AS label, CASE WHEN {k} % 2 = 1 THEN 'left' ELSE 'right' END AS side,
  3 + {k} % 4 AS a, 3 + {n} % 3 AS b, 3 + ({k} // 4) % 4 AS c, 6 + {k} % 3 AS cx, 8 AS cy, 7 + {n} % 2 AS cz FROM {table}),
voxel AS (SELECT mask_id, x::INT AS x, y::INT AS y, z::INT AS z FROM par, range({GRID}) gx(x), range({GRID}) gy(y), range({GRID}) gz(z)
  WHERE (x-cx)*(x-cx)*b*b*c*c + (y-cy)*(y-cy)*a*a*c*c + (z-cz)*(z-cz)*a*a*b*b <= a*a*b*b*c*c)"""
