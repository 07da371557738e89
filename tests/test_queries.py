"""Every registered query of the catalogue against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from lineleaf import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(values):
    return sorted((tuple(map(plain, r)) for r in values), key=lambda t: [(x is not None, str(x)) for x in t])


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    listed = ", ".join(f'"{n}"' for n in names)
    assert names == sorted(con.sql(catalogue.ORACLE_SQL[name]).columns)
    want = con.sql(f"select {listed} from ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert rows(df.select(*names).collect()) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() >= 0


def test_entry_imports_without_the_optional_parts(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
