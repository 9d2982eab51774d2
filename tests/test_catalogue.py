"""Every query of the catalogue against its SQL, at the smallest scale."""

import os

import pytest

from cutloom.plans import catalogue

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = ("part", "lineitem", "events", "orders", "customer", "nation")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    if name in catalogue.SQL:
        out = con.execute(catalogue.SQL[name])
        names = [d[0] for d in out.description]
        assert sorted(names) == cols
        assert sorted((tuple(r[names.index(c)] for c in cols) for r in out.fetchall()), key=repr) == got
