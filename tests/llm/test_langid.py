import random
import zlib

import numpy as np

from placeloom.llm import langid as L

SYLLABLES = {"en": ["th", "the", "ing", "and", "er", "ou", "wh"], "de": ["sch", "ein", "ung", "ü", "keit", "tz"], "fr": ["eau", "é", "oi", "ç", "ment", "qu"]}


def some_docs(n=900):
    rng = random.Random(2)
    langs = [rng.choice(["en", "en", "de", "fr"]) for _ in range(n)]
    texts = [" ".join("".join(rng.choice(SYLLABLES[x]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 60))).capitalize() for x in langs]
    return texts, langs


def test_held_out_accuracy_and_calibration(spark, make_docs):
    texts, langs = some_docs()
    texts += [None, "", "123 !!! ###", "12 é"]
    langs += [None, "en", "de", None]
    docs = make_docs(texts, langs=langs)
    model = L.fit(docs, per_language=150)
    assert model.languages == ["de", "en", "fr"] and 0.2 < (model.weights == 0).mean() < 1
    rows = {r.doc_id: r for r in L.identify(docs, model).withColumn("held_out", L.held_out()).collect()}
    assert len(rows) == len(texts)
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [i for i in rows if rows[i].held_out] == [i for i in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = np.mean([rows[i].lang_pred == langs[i] for i in held])
    assert right > 0.97
    assert abs(np.mean([rows[i].score for i in held]) - right) < 0.1
    for i in (900, 901, 902):
        assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
    assert rows[903].lang_pred == "fr"
    again = L.fit(docs.repartition(5), per_language=150)
    assert np.array_equal(again.weights, model.weights) and again.temperature == model.temperature


def test_nothing_to_learn_and_stage(spark, make_docs):
    docs = make_docs([])
    assert L.identify(docs, L.fit(docs)).count() == 0
    docs = make_docs(["hello there", None], langs=[None, None])
    assert {r.lang_pred for r in L.identify(docs, L.fit(docs)).collect()} == {"und"}
    texts, langs = some_docs(200)
    docs = make_docs([*texts, None, "??"], langs=[*langs, "en", "en"])
    kept = L.reject_unsure(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(200))


def test_stage_rejects_what_was_not_learnt(spark, make_docs):
    """Texts in unseen scripts go, however many languages there are."""
    foreign = ["Это совершенно другой язык, и его никто не учил", "这是一个完全不同的语言文本", "ελληνικό κείμενο", "абв", "Ο"]
    texts, langs = some_docs(300)
    rng = random.Random(8)
    texts += [" ".join("".join(rng.choice(["xñ", "zo", "ij", "ka", "øv"]) for _ in range(3)) for _ in range(20)) for _ in range(75)]
    langs += ["xx"] * 75
    for n in (1, 2, 3, 4):
        own = [t for t, x in zip(texts, langs, strict=True) if x in ["en", "de", "fr", "xx"][:n]]
        docs = make_docs(own + foreign, langs=[x for x in langs if x in ["en", "de", "fr", "xx"][:n]] + [None] * len(foreign))
        kept = {r.doc_id for r in L.reject_unsure(spark, docs, "").select("doc_id").collect()}
        assert kept == set(range(len(own))), n


def test_temperature():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=x) for x in p])
    assert abs(L.fitted_temperature(logits * 3, y) - 3) < 0.3


def test_every_language_is_learnt_and_repeated_ids_are_no_burden(spark, make_docs):
    langs = [f"l{i:03}" for i in range(210)] * 4
    texts = [" ".join(chr(0x4E00 + int(x[1:]) * 8 + j % 8) * 3 for j in range(12)) for x in langs]
    model = L.fit(make_docs(texts, langs=langs), per_language=2)
    assert len(model.languages) == 210
    docs = make_docs(["the same text"] * 400 + ["ein anderer Text", "noch ein Text"], langs=["en"] * 400 + ["de"] * 2, ids=[1] * 400 + [3, 4])
    assert L.fit(docs, per_language=5).languages == ["de", "en"]
