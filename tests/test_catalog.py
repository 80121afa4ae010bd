import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from passagelake.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    a, b = catalog.queries()[name](spark, DATA).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = [sorted((tuple(map(str, r)) for r in x[sorted(x.columns)].astype(object).values.tolist())) for x in (a, b)]
    assert rows[0] == rows[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.oracle_sql()) <= set(entry.queries())
