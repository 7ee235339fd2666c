"""Every corpus query that has SQL equals it on the smallest tables."""

import os

import pytest

from tessera.llm import queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def test_what_has_sql():
    assert len(queries.queries()) == 10
    assert queries.queries().keys() - queries.oracle_sql().keys() == {"op2_quality", "op4_pii", "op5_toxicity", "op8_bpe"}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(DIR):
        duck.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    df = queries.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    relation = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    expected = sorted((tuple(r[names.index(c)] for c in columns) for r in relation.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == expected
