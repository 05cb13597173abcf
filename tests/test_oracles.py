"""Every query of the core that has SQL gives the same rows as that SQL."""

import os

import pytest

from loomgraph.plans import registry, runs  # noqa: F401

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{folder}/{f}')")
    return c


def canon(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: "null" if v is None else f"{v:.5f}" if isinstance(v, float) else str(int(v)) if isinstance(v, (bool, int)) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, folder, con, name):
    df = registry.QUERIES[name](spark, folder)
    cur = con.execute(registry.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(names, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, folder, name):
    df = registry.QUERIES[name](spark, folder)
    assert df.columns
    df.count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
