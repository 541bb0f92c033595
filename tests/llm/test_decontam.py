import hashlib
import re

import pytest

from placeloom.llm import decontam as D


def plain_words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(texts, bench, n=10):
    wins = []
    for item, t in bench:
        ws = plain_words(t)
        if ws:
            k = min(n, len(ws))
            wins += [(str(item), ws[i : i + k]) for i in range(len(ws) - k + 1)]
    out = []
    for t in texts:
        ws, hit, ids = plain_words(t), set(), set()
        for item, w in wins:
            for i in range(len(ws) - len(w) + 1):
                if ws[i : i + len(w)] == w:
                    hit |= set(range(i, i + len(w)))
                    ids.add(item)
        out.append((len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("anchors", [1, 2])
def test_against_brute_force(spark, make_docs, words, anchors):
    items = [words(30) for _ in range(6)] + ["Σας ΣΑΣ σας", "one", None, "", "...", words(9), words(10)]
    items.append(items[0])
    bench = spark.createDataFrame([(i if i != 3 else 30, t, "x") for i, t in enumerate(items)], "item_id long, text string, pos string")
    part = lambda t, a, b: " ".join(t.split()[a:b])
    texts = [words(50) for _ in range(10)]
    texts += [words(20) + " " + items[0].upper().replace(" ", ", ") + ". " + words(5), part(items[1], 3, 13), part(items[1], 3, 12), items[2] + " " + items[2], part(items[4], 0, 12) + " zz " + part(items[4], 13, 30)]
    texts += [None, "", " \n", "one ONE one", "éone one", "ΣΑΣ ΣΑΣ σας Σας ΣΑΣ", items[11], items[12] + "!", (items[5] + " ") * 3 + words(3000)]
    docs = make_docs(texts)
    want = plain(texts, [(i if i != 3 else 30, t) for i, t in enumerate(items)])
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.contamination(docs, bench, anchors=anchors).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_ids_empty_tables_and_stage(spark, make_docs, words):
    item = words(12)
    bench = spark.createDataFrame([(None, item)], "item_id long, text string")
    docs = make_docs([item, "clean words here", item + " x", words(8)], ids=[None, None, 7, 7])
    rows = D.contamination(docs, bench).collect()
    assert sorted((r.n_words, r.contaminated) for r in rows) == [(3, False), (8, False), (12, True), (13, True)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in D.contamination(docs, none).collect()] == [0] * 4
    assert D.contamination(make_docs([]), bench).count() == 0


def test_stage_judges_each_row_by_its_own_text(spark, make_docs, words, tmp_path):
    item = words(12)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [item, "clean words here", None, item + " x", words(8), words(9)]
    docs = make_docs(texts, ids=[None, None, None, 7, 7, 8])
    kept = D.drop_contaminated(spark, docs, str(tmp_path))
    assert kept.dtypes == docs.dtypes
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted([(-1, texts[1]), (-1, ""), (7, texts[4]), (8, texts[5])])


def plain_near(texts, bench, slop, n=10, anchors=2):
    """(document, item, place) of near matches, by looking at all pairs of picked terms."""
    docs = [plain_words(t) for t in texts]
    count = {}
    for ws in docs:
        for w in ws:
            count[w] = count.get(w, 0) + 1
    out = set()
    for item, t in bench:
        ws, picked = plain_words(t), set()
        k = min(n, len(ws))
        for w in range(len(ws) - k + 1 if ws else 0):
            if all(x in count for x in ws[w : w + k]):
                picked |= {w + i for i in sorted(range(k), key=lambda i: (count[ws[w + i]], i))[:anchors]}
        for d, words in enumerate(docs):
            post = [(p, at) for at in picked for p, x in enumerate(words) if x == ws[at]]
            out |= {(d, str(item), p) for p, at in post for q, other in post if at != other and abs((p - at) - (q - other)) <= slop}
    return out


def test_proximity(spark, make_docs, words):
    items = ["alpha beta gamma delta", "aa bb", words(14), words(25), "bb", None, "nowhere to be found"]
    part = lambda t, a, b: " ".join(t.split()[a:b])
    texts = ["alpha x beta", "beta then alpha", "alpha beta", "alpha " + "z " * 30 + "beta gamma delta", "gamma delta", "aa bb x bb", "aa " * 5 + "bb " * 5, None, ""]
    texts += [part(items[2], 0, 6) + " q q " + part(items[2], 6, 14), " ".join(w + " q" for w in items[3].split()), words(200) + " " + items[3], words(50)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = make_docs(texts)
    for slop in (0, 2):
        want = plain_near(texts, list(enumerate(items)), slop)
        assert {(r.doc_id, r.item_id, r.pos) for r in D.proximity_matches(docs, bench, slop=slop).collect()} == want
        got = {r.doc_id: r.n_near for r in D.contamination(docs, bench, slop=slop).collect()}
        assert got == {d: len({p for e, _, p in want if e == d}) for d in range(len(texts))}
    assert (5, "1", 3) in want


def test_many_rows_without_id(spark, make_docs, words):
    item = words(12)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [item + f" {i}" for i in range(60)] + [words(20) for _ in range(60)] + [None] * 5
    rows = D.contamination(make_docs(texts, ids=[None] * len(texts)), bench).collect()
    assert sum(r.contaminated for r in rows) == 60 and len(rows) == 125
