"""The inverted file against all pairs, its recall, and the fusion."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeloom.operators import vectors as V


def make(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x") for i, v in rows], "item_id long, vector array<double>, cell string, id string")


def plain(rows, queries, k):
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in rows}
    return {(q, i, r + 1) for q in queries for r, (_, i) in enumerate(sorted((-round(float(unit[q] @ unit[i]), 9), i) for i in unit if i != q)[:k])}


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16)) * 3
    v = centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16))
    v[300:420] = v[7]  # a common vector
    return [(i, x.tolist()) for i, x in enumerate(v)]


def got(df):
    return {(r.query_id, r.item_id, r.rank) for r in df.collect()}


def test_all_cells_are_exact(spark, clustered):
    items = make(spark, clustered)
    want = plain(clustered, range(0, 900, 20), 10)
    for rows in (2048, 37):
        index = V.Index(items, "item_id", rows=rows)
        assert got(index.search(items.filter("item_id % 20 = 0"), "item_id", not_itself=True, rows=5 if rows == 37 else 256)) == want


def test_all_cells_move_each_query_once(spark, clustered, monkeypatch):
    """A search of all cells packs a query once, not once for each cell, and files few rows at a time."""
    items = make(spark, clustered)
    index, asked, packed, filed = V.Index(items, "item_id"), items.filter("item_id % 20 = 0"), V._packed, []
    monkeypatch.setattr(V, "_packed", lambda rows, n: filed.append(rows.count()) or packed(rows, n))
    want = plain(clustered, range(0, 900, 20), 10)
    assert len(index.centres) > 1
    for most in (V.BROADCAST_BYTES, 0):
        monkeypatch.setattr(V, "BROADCAST_BYTES", most)
        assert got(index.search(asked, "item_id", not_itself=True, rows=7)) == want
    assert filed == [45, 45]
    monkeypatch.setattr(V, "FILED_ROWS", 10)
    some = V._filed(V.usable(items, "item_id"), index.centres, 3)
    assert some.count() == 2700 and some.select("id", "cell").distinct().count() == 2700


def test_recall(spark, clustered):
    items = make(spark, clustered)
    index, asked = V.Index(items, "item_id"), items.filter("item_id % 20 = 0")
    probes = index.probes_for(asked, "item_id", not_itself=True, most=20)
    assert probes < len(index.centres) / 2
    exact = index.search(asked, "item_id", not_itself=True)
    assert V.recall(index.search(asked, "item_id", probes=probes, not_itself=True), exact) >= 0.9


def test_recall_on_a_given_table(spark):
    try:
        rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    except Exception:
        pytest.skip("no test tables")
    asked, index = rows.filter("vec_id % 20 = 0"), V.Index(rows, "vec_id", "embedding")
    found = index.search(asked, "vec_id", "embedding", probes=index.probes_for(asked, "vec_id", "embedding", not_itself=True), not_itself=True)
    assert V.recall(found, index.search(asked, "vec_id", "embedding", not_itself=True)) >= 0.9


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, []), (None, [1.0, 1.0]), (6, [math.nan, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [1.0, math.inf]), (10, [3.0, 0.0])]
    items = make(spark, rows)
    index = V.Index(items, "item_id")
    assert [(r.item_id, r.score) for r in index.search(items.filter("item_id = 1"), "item_id", not_itself=True).orderBy("rank").collect()] == [(10, 1.0), (2, 0.0), (3, 0.0)]
    assert index.search(items.filter("item_id in (4, 5, 8)"), "item_id").count() == 0
    none = items.filter("false")
    assert V.Index(none, "item_id").search(items, "item_id").count() == 0 and index.search(none, "item_id").count() == 0 and index.probes_for(none, "item_id") == 1


def test_fusion(spark):
    ranked = lambda rows: spark.createDataFrame(rows, "query_id long, item_id long, rank long")
    a, b = ranked([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)]), ranked([(1, 12, 1), (1, 13, 2), (3, 9, 1)])
    rows = V.fused(a, b, k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.item_id) for r in rows] == [(1, 12), (1, 10), (1, 11), (2, 10), (3, 9)]
    assert rows[0].score == round(1 / 61 + 1 / 63, 9)


def test_hybrid(spark):
    items = spark.createDataFrame([(1, 1, "red cup"), (2, 2, "blue cup"), (3, 3, "green tree")], "item_id long, ord long, text string")
    index = V.Index(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "item_id long, vector array<double>"), "item_id")
    asked = spark.createDataFrame([(7, "a blue cup", [0.0, 1.0]), (8, "nothing", None)], "query_id long, text string, vector array<double>")
    rows = V.hybrid_search(asked, items, index, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.item_id) for r in rows] == [(7, 2), (7, 1)] and rows[0].retrieval_mode == "hybrid_rank_fusion"
    assert dict(V.hybrid_search(asked, items, index, 2).select(F.col("rank")).dtypes) == {"rank": "bigint"}
