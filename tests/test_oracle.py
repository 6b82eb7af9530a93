"""Every query with SQL against that SQL, on the smallest tables; the others must run."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from waypost import queries as core

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, name):
    df = core.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(tidy(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = core.oracle_sql().get(name)
    if sql:
        c = duckdb.connect()
        for f in glob.glob(f"{DIR}/*.parquet"):
            c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        r = c.execute(sql)
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        assert got == sorted((tuple(tidy(row[names.index(x)]) for x in cols) for row in r.fetchall()), key=repr)


def test_entry_lists_core():
    assert set(core.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
