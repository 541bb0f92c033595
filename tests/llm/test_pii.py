import hashlib
import random
import re

from placeloom.llm import pii as P


def digits(s):
    return "".join(c for c in s if c in "0123456789")


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


PLAIN = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(digits(m[0])) <= 15),
}


def plain(text):
    return sorted(((k, m.start(), m.end()) for k, (p, ok) in PLAIN.items() for m in p.finditer(text or "") if ok(m)), key=lambda s: (s[1], list(PLAIN).index(s[0])))


def some_texts():
    rng = random.Random(9)
    parts = ["a.b", "@", "x@y.z", ".", "-", "_", "192.168.0.1", "300.1.1.1", "0255.1.2.3", "4111 1111 1111 1111", "4785380592391139", "+1 (988) 555-2485", "+", "(", ")", " ", "\n", "é", "9", "12", "555 123 4567", "٣", "%", "word"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(600)]


def test_base_spans():
    for t in some_texts():
        assert P.base_spans(t) == plain(t), t


def test_long_texts_are_linear():
    for t in ("a" * 300_000, "a" * 200_000 + "@", "1" * 300_000, "1." * 100_000, "+1" + " " * 200_000, "@" * 100_000, "1 " * 100_000):
        P.base_spans(t)


def test_many_spans_in_one_text():
    text = " ".join(f"a{i}@b.co 555-{200 + i % 700}-{1000 + i % 9000} 4111 1111 1111 1111" for i in range(20_000))
    base = P.base_spans(text)
    assert base == plain(text) and len(P.further_candidates(text, base)) > 0


def test_reliabilities_find_the_good_labeler():
    # the first labeler agrees with the others' majority, the fifth says the same of everything
    patterns = [("ssn", (1, 0, 1, 0, 1, 0), 400), ("ssn", (-1, 0, 0, -1, 1, -1), 300), ("ssn", (1, 0, 0, 0, 1, 0), 100), ("ssn", (-1, 0, 0, 0, 1, 0), 100)]
    got = P.reliabilities(patterns)
    assert got[patterns[0][:2]] > 0.9 > 0.4 > got[patterns[1][:2]]
    assert got[patterns[2][:2]] > 0.8 > 0.5 > got[patterns[3][:2]]
    assert P.reliabilities([]) == {}


def test_query_and_redaction(spark, make_docs):
    texts = [None, "", "write to bosbt.42@mail8.example.com now", "call +1 (988) 555-2485 or 555-213-4867 by phone", "ssn 123-45-6789 of Mr John Smith", "clean words only", "card 4111 1111 1111 1111"] + [f"my phone number is {200 + i}-{300 + i}-{1234 + 7 * i} thanks" for i in range(40)]
    docs = make_docs(texts)
    weights = P.fit(docs)
    got = {r.doc_id: r for r in P.scan(docs, weights).collect()}
    for i, t in enumerate(texts):
        base = plain(t)
        assert got[i].base_sha256 == hashlib.sha256(P.joined(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in P.BASE] == [sum(k == x for x, _, _ in base) for k in P.BASE]
        assert not base or set(P.joined(base).split(",")) <= set(got[i].spans.split(","))
    assert got[5].spans == "" and "local_phone" in got[10].spans
    out = {r.doc_id: r for r in P.redact(spark, docs, "").collect()}
    assert out[0].text is None and out[5].text == "clean words only"
    assert out[2].text == "write to [EMAIL] now" and out[2].n_chars == len(out[2].text)
    assert P.redact(spark, docs, "").columns == docs.columns
    assert P.scan(make_docs([]), P.fit(make_docs([]))).count() == 0
