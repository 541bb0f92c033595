import re

import xxhash

from placeloom.llm import simhash as S


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps):
    at = list(range(len(fps)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                at[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_against_brute_force(make_docs, words):
    texts = [words(40) for _ in range(30)]
    texts += [t + " " + words(1) for t in texts[:10]] + texts[5:8] + [None, "", "  \t", "One", "two WORDS", "TWO words", "É é", "x" * 50_000, "a\x1cb c\x85d e"]
    fps = [plain_fingerprint(t) for t in texts]
    want = plain_components(fps)
    for limit in (4, 0):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(make_docs(texts), bucket_limit=limit).collect()}
        assert got == {i: (f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, want, strict=True))}


def test_links_of_dense_codes(spark):
    """A crowd around one code: all links, whatever the bucket limit."""
    import random

    rng = random.Random(3)
    codes = {0, -1}
    while len(codes) < 150:
        x = 0x0123456789ABCDEF
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        codes.add(x - (1 << 64) if x >> 63 else x)
    codes = sorted(codes)
    want = plain_components([c & (1 << 64) - 1 for c in codes])
    for limit in (2, 1000):
        roots = {r.node: r.root for r in S.connected(S.links(spark.createDataFrame([(c,) for c in codes], "fp long"), limit)).collect()}
        assert [roots.get(c, c) for c in codes] == [codes[w] for w in want]


def test_empty_and_null_ids(make_docs):
    assert S.near_duplicates(make_docs([])).count() == 0
    got = S.near_duplicates(make_docs(["a b c d", "a b c d", "q r s t"], ids=[None, 4, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got if r.component_id) == [(-1, 4), (4, 4)]


def test_stage_keeps_one(spark, make_docs):
    docs = make_docs(["a b c d", "a b c d", "q r s t", "q r s t", "zz"], ids=[1, 2, 5, 5, None])
    kept = S.keep_one_of_each(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 5]


def test_stage_links_at_similarity(spark, make_docs, words):
    """Pairs at 0.8 or more on five words go, whatever their fingerprints' distance; those below stay."""
    base = [words(60).split() for _ in range(30)]
    edit = lambda ws, *at: " ".join("changed" if i in at else w for i, w in enumerate(ws))
    texts = [" ".join(b) for b in base] + [edit(b, 30) for b in base] + [edit(b, 10, 40) for b in base]
    grams = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    similar = lambda a, b: 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b])
    fps = [S.fingerprint(t) for t in texts]
    assert any(similar(i, i + 30) and (fps[i] ^ fps[i + 30]).bit_count() > 2 for i in range(30))
    at = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if similar(a, b):
                old, new = max(at[a], at[b]), min(at[a], at[b])
                at = [new if x == old else x for x in at]
    kept = {r.doc_id for r in S.keep_one_of_each(spark, make_docs(texts), "").select("doc_id").collect()}
    assert kept == set(at) and kept & set(range(60, 90)) and not kept & set(range(30, 60))


def test_stage_finds_texts_by_fingerprints_first(spark, make_docs, words, monkeypatch):
    """Of near copies, those within two bits are found by the index; the join finds the others, and compares none of them again."""
    base = [words(400).split() for _ in range(8)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:-1], "changed"]) for b in base] + [" ".join("changed" if i % 60 == 30 else w for i, w in enumerate(b)) for b in base]
    fps = [S.fingerprint(t, S.STAGE_SHINGLE) for t in texts]
    close = {(a, b) for a in range(24) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2}
    assert len(close) >= 6
    compared, similar = [], S._similar
    monkeypatch.setattr(S, "_similar", lambda pairs, *a: compared.append({tuple(sorted(r)) for r in pairs.select("u", "v").collect()}) or similar(pairs, *a))
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    found = {(max(r), min(r)) for r in S.alike(docs).collect()}
    assert found and found <= close and compared.pop() >= {tuple(sorted(p)) for p in found}
    kept = {r.doc_id for r in S.keep_one_of_each(spark, make_docs(texts), "").select("doc_id").collect()}
    assert kept == set(range(8)) and compared[0] and not compared[0] & compared[1]


def test_stage_tells_rows_apart_without_ids(spark, make_docs, words):
    """Copies without an id go like any other; different texts with one id both stay."""
    a, b, c, d = (words(40) for _ in range(4))
    docs = make_docs([a, a, a + " end", b, c, d, d, None, None], ids=[None, None, None, 5, 5, None, 9, None, None])
    kept = [(r.doc_id, r.text) for r in S.keep_one_of_each(spark, docs, "").collect()]
    assert len(kept) == 5 and {(5, b), (5, c), (9, d), (None, None)} < set(kept)
    assert sum(i is None and (t or "").startswith(a) for i, t in kept) == 1


def test_stage_keeps_columns_of_any_name(spark, words):
    names = ["_text", "_id", "_rows", "_node", "_row", "_whole", "row", "node", "other", "whole", "id", "rows", "root", "own", "own_id", "a.b", "u", "gram"]
    texts = [words(30), words(30)]
    rows = [(i, texts[i % 2], *[f"{n}{i}" for n in names]) for i in range(4)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    kept = S.keep_one_of_each(spark, docs, "")
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == rows[:2]


def test_texts_that_share_a_hash(spark):
    rows = [(1, 10, "a"), (1, 20, "b"), (1, 20, "b"), (1, 30, "c"), (2, 10, "d")]
    got = S._told_apart(spark.createDataFrame(rows, "node long, other long, text string")).collect()
    nodes = {r.text: r.node for r in got}
    assert len(got) == 5 and nodes["a"] == 1 and nodes["d"] == 2 and len(set(nodes.values())) == 4
