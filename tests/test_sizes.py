"""Tables that a few keys are made into must not be taken for small ones, or Spark sends them through the driver to be broadcast."""

import pytest

from formlens.plans import shape_inverse, shape_models
from formlens.sources import cohorts

SF_DIR = "/root/testdata/sf0.01"
TABLES = {
    "voxels": lambda spark: cohorts.masks(spark, SF_DIR, "supplier")[1:],
    "octahedra": lambda spark: shape_inverse._octahedra(spark, SF_DIR),
    "patches": lambda spark: shape_models._patches(spark, SF_DIR),
    "triangles": lambda spark: shape_models._triangles(spark, SF_DIR)[:1],
    "mapped": lambda spark: [shape_inverse._mapped(spark, SF_DIR)],
}


@pytest.mark.parametrize("name", TABLES)
def test_estimates_are_no_smaller_than_the_rows(spark, name):
    for table in TABLES[name](spark):
        estimate = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        assert estimate >= 4 * len(table.columns) * table.count()


def test_cells_are_not_broadcast(spark):
    """Without a look at real sizes first, as adaptive execution takes, the plan must leave the cells where they are."""
    from formlens.plans.catalogue import QUERIES

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES["mask_flip_left"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    side = plan[plan.index("BroadcastHashJoin") :].split("\n")[0]
    assert "BuildRight" in side, plan  # the masks' sides, not their cells
