"""Every registered query of the engine's own operators against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from lexmill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ALL))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    got = plain(map(tuple, df.select(*sorted(df.columns)).collect()))
    sql = registry.oracle_sql().get(name)
    if sql:
        r = con.execute(sql)
        columns = [c[0] for c in r.description]
        assert sorted(columns) == sorted(df.columns)
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        assert got == plain(tuple(x[i] for i in order) for x in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
