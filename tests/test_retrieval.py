"""The bounded search gives what comparing everything gives."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from placeloom.operators import retrieval as R
from placeloom.plans import reference


def plain(queries, items, k):
    out = set()
    for q, text in queries:
        want = list(dict.fromkeys((text or "").lower().split()))
        hits = sorted((-len(set(want) & set((t or "").lower().split())), o, i) for i, o, t in items)
        out |= {(q, i, round(-s / len(want), 4), "|".join(sorted(set(want) & set(next(t for x, _, t in items if x == i).lower().split()))), r + 1) for r, (s, o, i) in enumerate(h for h in hits if h[0] < 0) if r < k}
    return out


def tables(spark, queries, items):
    return spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(items, "item_id long, ord long, text string")


def got(df):
    return {tuple(r) for r in df.select("query_id", "item_id", "score", F.array_join("matched", "|").alias("matched"), "rank").collect()}


def case(n=300):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    items = [(1000 - i, i * 3, " ".join(["all", *rng.choices(vocab, weights, k=rng.randint(0, 9))])) for i in range(n)]
    items += [(5000, 9999, None), (5001, 9998, "")]
    rng.shuffle(items)
    queries = [(i, " ".join(rng.choices([*vocab, "all", "none"], [*weights, 0.5, 0.1], k=rng.randint(1, 6)))) for i in range(60)]
    return [*queries, (100, "all"), (101, "all none"), (102, None), (103, "..."), (104, "ALL all w59 w58"), (105, "none")], items


@pytest.mark.parametrize(("reach", "first_wave", "k"), [(40, 16, 5), (0, 8, 3), (10_000, 16, 5)])
def test_bounded_search(spark, reach, first_wave, k):
    queries, items = case()
    q, i = tables(spark, queries, items)
    want = plain([x for x in queries if x[1] and x[1] != "..."], items, k)
    assert got(R.search(q, i, k, reach=reach, first_wave=first_wave, direct=0)) == want
    assert got(R.search(q, i, k)) == want == got(R.search(q, i, k, direct=None))


def test_common_word_reads_few_rows(spark, monkeypatch):
    """A word in every item: a query for it and a rare word reads one wave, not the catalog."""
    items = [(i, i, f"all r{i // 4}") for i in range(20_000)]
    queries = [(j, f"all r{j * 11}") for j in range(200)]
    q, i = tables(spark, queries, items)
    kept, stored = [], R.stored
    monkeypatch.setattr(R, "stored", lambda df, name: kept.append((name, stored(df, name))) or kept[-1][1])
    rows = got(R.search(q, i, 3, reach=50, first_wave=64, direct=0))
    assert {(a, b) for a, b, *_ in rows} == {(j, 44 * j + x) for j in range(200) for x in range(3)}
    assert max(df.count() for name, df in kept if name == "search-found") <= 200 * 50
    assert [df.count() for name, df in kept if name == "search-open"] == [0]  # four items have both words: done without the long list
    kept.clear()
    only = spark.createDataFrame([(1, "all")], "query_id long, text string")
    assert [b for _, b, *_ in sorted(got(R.search(only, i, 3, reach=50, first_wave=64, direct=0)))] == [0, 1, 2]
    assert [df.count() for name, df in kept if name == "search-open"] == [1, 0]  # one wave


def test_few_queries_move_no_items(spark, monkeypatch):
    """Items are read where they are: what is shuffled are each query's best of a piece, whatever the number of items."""
    monkeypatch.setattr(R, "PIECE", 37)
    queries, items = case()
    q, i = tables(spark, queries, items)
    want = plain([x for x in queries if x[1] and x[1] != "..."], items, 5)
    assert got(R.search(q, i, 5, few=0)) == want
    monkeypatch.setattr(R, "_token_lists", None)  # the ways that shuffle tokens
    assert got(R.search(q, i.repartition(3), 5)) == want
    many = spark.range(20_000).select(F.col("id").alias("item_id"), F.col("id").alias("ord"), F.concat(F.lit("all r"), F.col("id") % 5000).alias("text"))
    found = R._scanned(R._Asked.of(spark.createDataFrame([(1, "all r77"), (2, "all")], "query_id long, text string"), 100), many.repartition(2), 3)
    assert found.count() < 5000 and [r.item_id for r in R.best(found, 3).orderBy("query_id", "rank").collect()] == [77, 5077, 10077, 0, 1, 2]


@pytest.mark.parametrize("few", [0, 1000])
def test_holding(spark, few):
    """Texts cut inside words, of one or two words, with characters that are special in patterns, and none."""
    texts = ["a red cup, a blue cup", "xab cdy", "ab", "A red cup", "", None, "één twee drie", "the the", "50% (off) now"]
    asked = ["red cup, a bl", "ab cd", "b", "red", "een", "n twee d", "e th", "% (", "0% (off) n", "", None, "twee", "cup, a blue cup!"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    i = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    words = lambda t: set("".join(c if c.isascii() and (c.isalnum() or c == "_") else " " for c in t.lower()).split())
    for least in (1, 3):
        want = {(a, b) for a, x in enumerate(asked) for b, y in enumerate(texts) if x and y is not None and len(words(x)) >= least and x in y}
        assert want and {tuple(r) for r in R.holding(q, i, least, few).collect()} == want


@pytest.mark.parametrize("few", [0, 1000])
def test_holding_without_words(spark, few):
    """Texts without a word are looked for as well; an empty one is held by every text, a null by none."""
    texts, asked = ["a - b", "", None, "...", "één"], ["", None, "-", "..", "é", "?", "a"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    i = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    want = {(a, b) for a, x in enumerate(asked) for b, y in enumerate(texts) if x is not None and y is not None and x in y}
    got = [tuple(r) for r in R.holding(q, i, 0, few).collect()]
    assert len(got) == len(want) == 4 + 1 + 1 + 1 + 1 and set(got) == want


def test_short_items_are_judged(spark, tmp_path):
    """Items of one or two different words can be hits, as longer ones can; one without words finds nothing."""
    texts = ["cupboard", "a red cup, a blue cup", "The cup", "tea the the", "tea for two", "x...", None, "", "lemon tea"]
    asked = {"cup": 0, "red cup": 1, "tea the the": 1, "tea": 1, "lemon": 1, "the the": 1, "a red cup, a": 1, "...": 0, "": 0, None: 0, "milk": 0, "The": 1, "blue cup": 1}
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = {r.query_id: r.hit for r in reference.top_k_hit(spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(reference.ORACLES["top_k_hit"]).fetchall()) == dict(enumerate(asked.values()))
    recall = {r.query_id: r.recall for r in reference.recall_at_k(spark, str(tmp_path)).collect()}
    assert recall == dict(con.execute(reference.ORACLES["recall_at_k"]).fetchall())


def test_numbered(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, "x") for i in range(1000)], "ord long, x string").repartition(5)
    assert all(r.place == r.ord for r in R.numbered(df, "ord").collect()) and R.numbered(df, "ord").count() == 1000


def test_scratch_tables_can_be_dropped(spark):
    from placeloom.sources import tables

    tables.drop_scratch(spark)
    kept = tables.stored(spark.range(3), "kept")
    assert kept.count() == 3 and len(kept.inputFiles()) > 0
    path = kept.inputFiles()[0].rsplit("/", 1)[0]
    assert tables.exists(spark, path) and tables.drop_scratch(spark) == 1 and not tables.exists(spark, path) and tables.drop_scratch(spark) == 0
