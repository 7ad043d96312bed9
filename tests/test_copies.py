from formlens.operators import chains, copies
from formlens.plans.catalogue import SHAPE
from formlens.sources import cohorts
from pyspark.sql import functions as F

SHAPES = {1: [(0, 0, 0), (1, 0, 0)], 2: [(1, 0, 0), (0, 0, 0)], 3: [(0, 0, 0), (0, 1, 0)], 5: [(0, 0, 0), (1, 0, 0)], 6: [(0, 0, 70), (-1, 0, 0)], 7: [(0, 0, 70), (-1, 0, 0)], 9: [(0, 0, 6), (-1, 0, 0)]}


def _voxel(spark):
    return spark.createDataFrame([(m, *c) for m, cells in SHAPES.items() for c in cells], "mask_id long, x int, y int, z int")


def _seen(own, found):
    found.extend(r[0] for r in own.select("mask_id").distinct().collect())
    return own.groupBy("mask_id").agg(F.sum("y").alias("y"), F.max("z").alias("z"))


def test_equal_masks_are_worked_out_once_and_each_has_its_rows(spark):
    found = []
    got = copies.once(_voxel(spark), lambda own: _seen(own, found))
    assert sorted(found) == [1, 3, 6, 9]
    assert sorted(map(tuple, got.collect())) == [(m, sum(c[1] for c in cells), max(c[2] for c in cells)) for m, cells in SHAPES.items()]


def test_masks_of_other_rows_are_not_equal(spark):
    meta = spark.createDataFrame([(m, [float(m % 2)]) for m in SHAPES], "mask_id long, size array<double>")
    found = []
    assert copies.once(_voxel(spark), lambda own: _seen(own, found), meta).count() == len(SHAPES)
    assert sorted(found) == [1, 2, 3, 6, 7, 9]


def test_many_copies_are_dealt_into_cells(spark):
    voxel = spark.range(1000).select(F.col("id").alias("mask_id"), F.lit(1).alias("x"), F.lit(2).alias("y"), F.lit(3).alias("z"))
    known = copies.alike(copies.cell_digests(voxel))
    sizes = [r["n"] for r in copies.cells(known).select(F.size("members").alias("n")).collect()]
    assert len(sizes) == 4 and sum(sizes) == 1000
    assert copies.handed(voxel.filter("mask_id = 0"), known).agg(F.count_distinct("mask_id")).first()[0] == 1000


def test_a_chain_solves_a_shape_once(spark):
    voxel = cohorts.masks(spark, "/root/testdata/sf0.01", "supplier")[1].filter("mask_id in (1, 49, 50)")
    twin = voxel.filter("mask_id = 1").withColumn("mask_id", F.lit(1000).cast("long"))
    rows = {r["mask_id"]: r["eigenvalues"] for r in chains.mask_spectra(voxel.unionByName(twin), SHAPE, 6).collect()}
    assert sorted(rows) == [1, 49, 50, 1000] and rows[1] == rows[1000]
