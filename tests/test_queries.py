"""Every registered query with SQL gives the SQL's rows (on the smallest tables)."""

import glob
import os

import duckdb
import pytest

from quernstone.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p).split('.')[0]} AS SELECT * FROM '{p}'")
    return c


def rows(columns, values):
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in SQL:
        rel = duck.sql(SQL[name])
        assert got == rows(rel.columns, rel.fetchall())
