"""Every registered archive query against its SQL on the smallest tables."""

import collections
import math
import os

import duckdb
import pytest

from siltstone.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Q, S = registry.queries(), registry.oracle_sql()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return int(x) if isinstance(x, float) and x == int(x) else bytes(x) if isinstance(x, bytearray) else x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, duck, name):
    df = Q[name](spark, SF)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    if name not in S:
        assert got
        return
    cur = duck.execute(S[name])
    at = {d[0]: k for k, d in enumerate(cur.description)}
    assert sorted(at) == cols
    want = collections.Counter(tuple(plain(r[at[c]]) for c in cols) for r in cur.fetchall())
    assert got == want
