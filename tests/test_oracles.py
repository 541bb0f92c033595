"""Each query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from placeloom.plans import reference

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return int(v) if hasattr(v, "__index__") else v


@pytest.mark.parametrize("name", sorted(reference.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = reference.QUERIES[name](spark, SF)
    rel = con.execute(reference.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    key = lambda r: [repr(x) for x in r]
    got = sorted(([plain(r[c]) for c in sorted(names)] for r in df.collect()), key=key)
    want = sorted(([plain(r[names.index(c)]) for c in sorted(names)] for r in rel.fetchall()), key=key)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0 and set(reference.QUERIES) <= set(e.queries()) and set(reference.ORACLES) <= set(e.oracle_sql())
