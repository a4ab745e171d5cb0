"""Every query with SQL gives DuckDB's rows."""

from collections import Counter

import duckdb
import pytest

from quarry.plans import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = Counter(tuple(r[c] for c in cols) for r in df.collect())
    if name not in registry.SQL:
        assert got
        return
    rel = duck.execute(registry.SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    want = Counter(tuple(r[names.index(c)] for c in cols) for r in rel.fetchall())
    assert got == want, f"{list((got - want).items())[:3]} {list((want - got).items())[:3]}"
