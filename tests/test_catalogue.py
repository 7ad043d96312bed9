import duckdb
import pytest

import formlens.plans.shape_fields
import formlens.plans.shape_frames
import formlens.plans.shape_inverse
import formlens.plans.shape_models
import formlens.plans.shape_plane  # noqa: F401 (all add queries)
from formlens.plans.catalogue import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("nation", "supplier", "lineitem", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_as_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    want = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r) for r in got.select(columns).collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
