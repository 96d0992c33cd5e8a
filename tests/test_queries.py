import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(same(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.engine.SQL))
def test_query_equals_its_sql(spark, con, name):
    df = entry.engine.QUERIES[name](spark, D)
    names = sorted(df.columns)
    result = con.execute(entry.engine.SQL[name])
    found = [c[0] for c in result.description]
    assert sorted(found) == names
    want = sorted(repr([same(dict(zip(found, r))[n]) for n in names]) for r in result.fetchall())
    assert sorted(repr([same(r[n]) for n in names]) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
