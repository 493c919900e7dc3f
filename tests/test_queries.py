"""Every query of the library against its DuckDB text on the smallest tables."""

import os

import duckdb
import pytest

from tallyrank.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = registry()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return round(v, 5) + 0.0 if isinstance(v, float) else int(v) if isinstance(v, bool) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    run, sql = QUERIES[name]
    df = run(spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        assert got
        return
    rel = duck.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    want = rows(rel.columns, rel.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-5) if all(isinstance(x, (int, float)) for x in a) else a == b
