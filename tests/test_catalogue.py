"""Every query of the catalogue equals its SQL on the smallest tables."""

import os

import pytest

from tessera.plans import catalogue

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


def test_every_query_has_sql():
    assert catalogue.queries().keys() == catalogue.oracle_sql().keys() and len(catalogue.queries()) >= 50


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    relation = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in relation.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == expected
