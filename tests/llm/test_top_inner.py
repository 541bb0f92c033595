import math

import duckdb
import numpy as np
import pytest

from placeloom.llm import top_inner as T

SCHEMA = "vec_id long, embedding array<double>, label int, q string, pile string, block string"


def plain(rows, k=20):
    """Rows (vec_id, vector) to the sorted rows of the result."""
    ok = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qid, q in {r for r in ok if r[0] % 20 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in ok if i != qid)[:k]  # noqa: B905 (shorter ones are padded with zeros)
        out += [(qid, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def make(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "x", "x") for i, v in rows], SCHEMA)


def got(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"] and [t for _, t in df.dtypes] == ["bigint", "int", "bigint", "bigint"]
    return sorted(map(tuple, df.collect()))


def vectors(n=400, dim=9, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) * np.linspace(2, 0.1, dim) * rng.lognormal(sigma=1, size=(n, 1))  # lengths and directions differ
    v[50:120] = v[7]  # a common vector
    v[200:210] = 0
    return [(i, x.tolist()) for i, x in enumerate(v)]


@pytest.mark.parametrize(("cells", "query_rows", "piles"), [(1 << 17, 256, 3), (150, 4, 11), (9, 1, 2)])
def test_equals_all_pairs(spark, cells, query_rows, piles):
    rows = vectors(400 if cells > 9 else 120)
    assert got(T.top_inner(make(spark, rows), cells=cells, query_rows=query_rows, piles=piles)) == plain(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, []), (40, [-1.0]), (1, [0.5, -0.5, 3.0]), (2, None), (None, [1.0]), (3, [1.0, None]), (4, [math.nan]), (5, [math.inf, 1.0]), (7, [0.0, 0.0]), (7, [0.0, 0.0]), (-20, [0.01, -0.01]), (60, [1.0, 1.0]), (60, [2.0, 1.0]), (9, [1e5, 1e5])]
    assert got(T.top_inner(make(spark, rows), k=20)) == plain(rows)
    assert got(T.top_inner(make(spark, rows), k=2, cells=2, query_rows=1)) == plain(rows, 2)


def test_large_numbers(spark):
    big = [(0, [2.0**40, 1.0]), (1, [2.0**10, 3.0]), (2, [2.0**10, 5.0]), (3, [1.0, 2.0]), (20, [2.0**50, 0.0])]
    rows = {r[:3]: r[3] for r in got(T.top_inner(make(spark, big)))}
    assert rows == {k[:3]: max(-(2**63), min(2**63 - 1, k[3])) for k in plain(big)}


def test_empty(spark):
    assert T.top_inner(make(spark, [])).count() == 0
    assert T.top_inner(make(spark, [(0, [1.0])])).count() == 0
    assert T.top_inner(make(spark, [(1, [1.0]), (2, None)])).count() == 0


def test_sql_gives_the_same():
    rows = [(i, v) for i, v in vectors()] + [(1000, None), (1020, [math.nan] * 9), (None, [1.0] * 9)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert sorted(con.execute(T.OP11_SQL).fetchall()) == plain(rows)


def test_bound_prunes():
    """Long vectors first: later ones are not scored, and none that counts is lost."""
    rng = np.random.default_rng(5)
    turn = np.eye(8)
    m = (rng.normal(size=(600, 8)) * np.linspace(40, 1, 600)[:, None]).astype(np.int64)
    m = m[np.argsort(-np.linalg.norm(m, axis=1))]
    side = lambda x, ids: T._Side(ids.tobytes(), "<i8", x.tobytes(), turn, 3)
    best, seen = T._Best(side(m[:5], np.arange(5) + 10_000), 3, None), []
    scores = best.scores
    best.scores = lambda c, part, i, j: seen.append(len(i)) or scores(c, part, i, j)
    best.see(side(m, np.arange(600)))
    assert sum(seen) < 5 * 600 / 2
    want = [sorted((-int(x), i) for i, x in enumerate(m @ q))[:3] for q in m[:5]]
    assert sorted(zip(best.slot.tolist(), best.id.tolist(), best.score.tolist(), strict=True)) == sorted((s, i, -x) for s, w in enumerate(want) for x, i in w)
