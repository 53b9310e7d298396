"""Every registered query with SQL, held against DuckDB on a small set of tables."""

import glob
import math
import os

import duckdb
import pytest

from tallyhouse import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(float(f"{x:.10g}"))
    return str(x)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(norm(r[c]) for c in sorted(names)) for r in df.collect())
    order = [names.index(c) for c in sorted(names)]
    assert got == sorted(tuple(norm(r[i]) for i in order) for r in want.fetchall())
    assert got or name.startswith("val")
