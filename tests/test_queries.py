"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from lexlake.plans import catalogue

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def canonical(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("" if r[i] is None else str(int(r[i])) if isinstance(r[i], bool) else str(r[i]) for i in order) for r in data)


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, D)
    got = df.collect()
    assert got, "a query without rows proves nothing"
    if name in catalogue.ORACLE_SQL:
        want = duck.sql(catalogue.ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert canonical(df.columns, got) == canonical(want.columns, want.fetchall())
