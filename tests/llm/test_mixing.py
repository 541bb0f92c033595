from collections import defaultdict

import numpy as np

from placeloom.llm import mixing as M


def plain_targets(sizes):
    """sizes: source -> words. Reshare by weight until no target is above its bound."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        left = budget - sum(out.values())
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > 2 * sizes[s]]
        if not over:
            total = sum(w[x] for x in free)
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
        free -= set(over)
    return out


def check(rows, texts, sources):
    sizes = defaultdict(int)
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len((t or "").encode().split())
    want, taken, largest = plain_targets(sizes), defaultdict(int), defaultdict(int)
    assert len(rows) == len(texts)
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").encode().split())
        assert r.source == sources[r.doc_id] and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest[s] + 1


def test_targets_and_rounding(make_docs, words):
    rng = np.random.default_rng(1)
    sources = [[None, "a", "b", "é", "Z", "hot", "hot", "hot"][i] for i in rng.integers(0, 8, 400)]
    texts = [words(int(n)) for n in rng.integers(0, 60, 400)]
    texts[3], texts[4], texts[5] = None, "", "w " * 3000
    docs = make_docs(texts, sources=sources)
    rows = M.mix(docs, block_rows=16, fan=3).collect()
    check(rows, texts, sources)
    again = M.mix(docs.repartition(7), block_rows=16, fan=3).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_empty_zero_and_repeated(make_docs):
    assert M.mix(make_docs([])).count() == 0
    rows = M.mix(make_docs([None, "", "  "])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 3
    assert M.mix(make_docs(["a b"] * 4, ids=[1, 1, 1, None])).count() == 4


def test_pivotal_keeps_words_and_probabilities():
    p = np.array([0.3, 0.7, 0.5, 0.5, 0.25, 0.75, 0.4, 1.0, 0.0])
    sizes = np.array([90.0, 40.0, 40.0, 30.0, 20.0, 10.0, 0.0, 7.0, 5.0])
    rng, seen = np.random.default_rng(0), np.zeros(9)
    for _ in range(6000):
        out, at, share = M.pivotal(p, sizes, rng.random(9))
        given = out.astype(float)
        if at >= 0:
            given[at] = share
            out[at] = rng.random() < share
        assert abs((given * sizes).sum() - (p * sizes).sum()) < 1e-6
        seen += out
    assert np.abs(seen / 6000 - p).max() < 0.04 and seen[7] == 6000 and seen[8] == 0


def test_words_come_near_the_target(make_docs, words):
    rng = np.random.default_rng(5)
    texts = [words(int(n)) for n in rng.integers(1, 80, 600)] + ["w " * 2500]
    sources = [["a", "b", "c"][i % 3] for i in range(600)] + ["c"]
    rows = M.mix(make_docs(texts, sources=sources), block_rows=64, fan=2).collect()
    for s in "abc":  # an open document of c may be the long one
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= (2500 if s == "c" else 80)


def test_null_and_repeated_ids_are_dealt_apart(make_docs, words, monkeypatch):
    texts = [words(20) for _ in range(150)] + ["the same words again"] * 150
    docs = make_docs(texts, sources=["a", "b"] * 150, ids=[None] * 200 + [7] * 100)
    monkeypatch.setattr(M, "PIECE", 16)
    rows = M.mix(docs, block_rows=16, fan=4).collect()
    again = M.mix(docs.repartition(5), block_rows=16, fan=4).collect()
    assert len(rows) == 300 and sorted(map(repr, rows)) == sorted(map(repr, again))
    for s in "ab":
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 20
