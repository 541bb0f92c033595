import hashlib
import random
from collections import Counter

import pytest

from placeloom.llm import repeats as R


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def plain_passages(texts):
    """Covered bytes and runs, by looking up each passage in all places."""
    data, strings = [(t or "").encode() for t in texts], []
    white = b" \t\n\v\f\r"
    for d in data:
        ends = [i + 1 for i in range(len(d)) if d[i] not in white and (i + 1 == len(d) or d[i + 1] in white)]
        own = []
        for i in range(len(d)):
            after = [e for e in ends if e > i][: R.WORDS]
            size = after[-1] - i if len(after) == R.WORDS else R.LENGTH
            size = min(max(size, R.WINDOW), R.LENGTH)
            own.append(d[i : i + size] if i + size <= len(d) else None)
        strings.append(own)
    seen = Counter(s for own in strings for s in own if s is not None)
    out = []
    for d, own in zip(data, strings, strict=True):
        told = [False] * len(d)
        for i, s in enumerate(own):
            if s is not None and seen[s] > 1:
                told[i : i + len(s)] = [True] * len(s)
        out.append((sum(told), sum(g and not (i and told[i - 1]) for i, g in enumerate(told))))
    return out


def some_texts(words):
    rng = random.Random(4)
    passage, line, short = words(90), "x" * 30 + words(70), words(56)
    texts = [words(rng.randint(0, 300)) for _ in range(15)]
    texts += [texts[2], texts[3] + " tail", "head " + texts[4], None, "", "short", "a" * 255, "a" * 256, "a" * 399, "a" * 400, "a" * 401, "a" * 1500, "ab" * 700, "é" * 500, "a\0" * 300]
    for _ in range(8):
        texts.append(words(rng.randint(0, 60)) + passage[rng.randint(0, 60) :] + words(rng.randint(0, 60)) + line + words(3))
    texts += [words(30) + " " + short + " " + words(20), short, words(5) + " " + short]
    edited = list(texts[5] or "")
    for _ in range(4):
        edited[rng.randrange(len(edited))] = "#"
    return [*texts, "".join(edited)]


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_against_brute_force(make_docs, words, crowd):
    texts = some_texts(words)
    assert 300 < len(texts[-3]) < R.LENGTH  # a passage of over 50 words that is shorter than what is removed
    rows = {r.doc_id: r for r in R.remove_repeats(make_docs(texts), crowd=crowd).collect()}
    got = [(rows[i].n_bytes, rows[i].n_bytes - len(rows[i].kept), len(rows[i].spans), hashlib.sha256(rows[i].kept).hexdigest()) for i in range(len(texts))]
    assert got == plain(texts, R.LENGTH)
    told = [(sum(x.end - x.start for x in rows[i].passages), len(rows[i].passages)) for i in range(len(texts))]
    assert told == plain_passages(texts) and told[-3][1] == 1


def test_repeated_rows_and_empty(make_docs, words):
    t = words(100)
    rows = R.remove_repeats(make_docs([t, t, words(90), words(100)], ids=[1, 1, None, 1])).collect()
    assert sorted(len(r.kept) == r.n_bytes for r in rows) == [False, False, True, True]
    assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 1, 1]
    assert R.remove_repeats(make_docs([])).count() == 0


def test_texts_are_shuffled_once(spark, make_docs, words, tmp_path):
    make_docs([words(200) for _ in range(20)] + [words(70) + some for some in some_texts(words) if some]).write.parquet(f"{tmp_path}/d.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = R.remove_repeats(spark.read.parquet(f"{tmp_path}/d.parquet")).select("doc_id", "kept")
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "ReusedExchange [doc" in plan and plan.count("FileScan parquet [doc_id") == 1


def test_chunks_change_nothing(words, monkeypatch):
    data = words(4000).encode()
    whole = R.parse(data)
    monkeypatch.setattr(R, "_CHUNK", 1000)
    cut = R.parse(data)
    strings = lambda p: {(s + i, t) for s, k, t in zip(p[0].tolist(), p[1].tolist(), p[3].tolist(), strict=True) for i in range(k)}
    assert strings(whole) == strings(cut) and len(strings(whole)) == len(data) - R.WINDOW + 1
