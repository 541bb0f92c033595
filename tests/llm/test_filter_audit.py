import re
from collections import defaultdict
from itertools import permutations

import duckdb
import pytest

from placeloom.llm import filter_audit as A

LABELS = "doc_id long, quality int, toxic int, part string, n string"


def plain(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic). part, order, step -> the numbers."""
    first, rows = {}, []
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        rows.append((s or "", {k for k, v in fails.items() if v}, any(a == i and q == 1 for a, q, _ in labels if a is not None), any(a == i and x == 1 for a, _, x in labels if a is not None)))
    out, shapley = {}, defaultdict(int)
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for p in permutations("ABCDE"):
            here = own
            for k, f in enumerate(p):
                gone = [r for r in here if f in r[1]]
                here = [r for r in here if f not in r[1]]
                shapley[part, f] += len(gone)
                out[part, "".join(p), k + 1] = [len(here), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {k: tuple(v + [shapley[k[0], k[1][k[2] - 1]]]) for k, v in out.items()}


def got(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def case(make_docs, spark):
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", "a a a a", "AB" * 5 + " x", long, long, long + " $", long, "x " * 300, "x " * 300 + "#", long + " Z", " é\x0b漢\x1fz", "tail\n" * 20_000, long, "", long + " |"]
    sources = ["s", None, "s", "s", "t", "t", "", "s", "t", "u", "s", "s", "u", None, "t", "t"]
    ids = [5, 4, None, 3, 9, 7, 7, 8, 1, 2, 10, 11, 12, None, 4, 7]
    labels = [(9, 1, 0), (9, 0, 1), (7, 1, None), (None, 1, 1), (1, None, 1), (2, 1, 1), (99, 1, 1), (12, 0, 0), (4, 1, 1)]
    return make_docs(texts, sources=sources, ids=ids), spark.createDataFrame([(*x, "x", "x") for x in labels], LABELS), list(zip(ids, texts, sources, strict=True)), labels


def test_all_orders(case):
    docs, marks, rows, labels = case
    want = plain(rows, labels)
    assert len(want) == 600 * len({s or "" for _, _, s in rows})
    assert got(A.audit(docs, marks)) == want


def test_sql_gives_the_same(case):
    docs, marks, rows, labels = case
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR); CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    cols = [d[0] for d in con.execute(A.OP13_SQL).description]
    found = {r[:3]: r[3:] for r in con.execute(A.OP13_SQL).fetchall()}
    assert cols == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert found == plain(rows, labels)


def test_copies_of_one_text(make_docs, spark):
    docs = make_docs(["same text"] * 500 + ["other"], sources=["hot"] * 501)
    none = spark.createDataFrame([], LABELS)
    rows = got(A.audit(docs, none))
    assert rows["hot", "EABCD", 1][:2] == (2, 499) and rows["hot", "AEBCD", 1][:2] == (0, 501)
    assert got(A.audit(docs.unionByName(docs), none))["hot", "EABCD", 1][:2] == (4, 998)  # repeated rows share their id


def test_empty(make_docs, spark):
    df = A.audit(make_docs([]), spark.createDataFrame([], LABELS))
    assert df.count() == 0 and dict(df.dtypes)["step"] == "int"


def test_other_filters(spark):
    """The steps work for any flags and any number of them."""
    counts = spark.createDataFrame([("p", False, False, 5, 1, 0), ("p", True, False, 3, 1, 1), ("p", True, True, 2, 0, 0)], "part string, x boolean, y boolean, n long, good long, toxic long")
    rows = got(A.steps(A.survivors(counts, ["x", "y"], ["n", "good", "toxic"]), ["x", "y"]))
    assert rows == {("p", "xy", 1): (5, 5, 0, 3, 1, 1, 8), ("p", "xy", 2): (5, 0, 2, 0, 0, 0, 2), ("p", "yx", 1): (8, 2, 0, 0, 0, 0, 2), ("p", "yx", 2): (5, 3, 2, 3, 1, 1, 8)}
