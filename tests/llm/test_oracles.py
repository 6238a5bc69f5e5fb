"""The registered queries that SQL can express, against it on the smallest tables."""

import os

import pytest

from tessera.llm.queries import ORACLE, QUERIES
from tests.test_queries import SF, plain

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_and_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(ORACLE[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == cols
    want = sorted(tuple(plain(r[have.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want
