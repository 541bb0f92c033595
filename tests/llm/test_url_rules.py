import itertools
import math
import random
import re

from placeloom.llm import url_rules as U


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in U.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_against_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "http://planet/", "http://example.net/en/1", "http://a.example.net/en", "http://a.example.net/en/?q#f", "https://example.com/de/x://y", "https://www.example.com/de", "http://x.org/fr/", "http://x.org?/fr/", "http://É.Org/fr/é#", "a://b://c.net/", "http://c.net:80/", "http://spam.example.org/en/1?utm=1", "http://spam.good.org/a-b/2", "http://farm.example.org/en/2", "http://host1.example.org/en/2"]
    urls += [f"http://spam-farm.host{i}.org/x/{i}" for i in range(30)] + [f"http://good{i}.example.net/en/{i}" for i in range(30)]
    pages = spark.createDataFrame([(i, u, "h", "k", "t") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, html string, key string, tokens string")
    rows = {r.page_id: r for r in U.judge(pages, min_support=0.05).collect()}
    assert len(rows) == len(urls) + 3
    for i, u in enumerate(urls + urls[:3]):
        host, path, rule = plain(u)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule), u
        if rule:
            assert rows[i].verdict == U.RULES[rule] and rows[i].mined is None
    by = {u: rows[i].verdict for i, u in enumerate(urls)}
    assert by["http://spam.example.org/en/1?utm=1"] == "block" and by["http://farm.example.org/en/2"] == "block" and by["http://x.org?/fr/"] == "allow" and by["http://host1.example.org/en/2"] == by[None] == "allow"


def plain_rules(rows, min_support, min_confidence, min_count):
    """Pruned rules of up to three tokens, by trying all combinations."""
    least = max(min_count, math.ceil(min_support * len(rows)))
    sets = [(set(t), y == "block") for t, y in rows]
    found = {}
    for n in (1, 2, 3):
        for c in {c for t, bad in sets if bad for c in itertools.combinations(sorted(t), n)}:
            hit = [bad for t, bad in sets if t >= set(c)]
            if sum(hit) >= least and sum(hit) / len(hit) >= min_confidence:
                found[c] = sum(hit) / len(hit)
    return {c: x for c, x in found.items() if not any(found.get(p, -1) >= x for n in range(1, len(c)) for p in itertools.combinations(c, n))}


def test_rules_by_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(260):
        tokens = sorted({f"{rng.choice('hpq')}:{rng.choice('abcdefgh')}" for _ in range(rng.randint(1, 14))})
        bad = {"h:a", "p:b"} <= set(tokens) or "q:c" in tokens and rng.random() < 0.93
        rows.append((tokens, "block" if bad else "open"))
    # no two tokens may stand on the same urls here: the plain version does not merge them
    df = spark.createDataFrame(rows, "tokens array<string>, label string")
    for support, count in ((0.05, 5), (0.02, 4)):
        got = {tuple(r.tokens): r.confidence for r in U.mined_rules(df, support, 0.9, count).collect()}
        want = plain_rules(rows, support, 0.9, count)
        assert want and got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in want)


def test_rules_hold_by_count(spark):
    labelled = [(["h:a", "h:b"], "block")] * 18 + [(["h:a", "h:c"], "allow")] * 20 + [(["h:b"], "block")] * 4 + [(["h:c", "h:d"], "block")]
    got = U.mined_rules(spark.createDataFrame(labelled, "tokens array<string>, label string"), 0.1, 0.9).collect()
    assert [(r.tokens, r.confidence, r.key) for r in got] == [(["h:b"], 1.0, "h:b")]
    assert U.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_long_and_repeated_urls(spark):
    long = "http://spam.x.org/" + "/".join(f"part{i}" for i in range(30))
    near = [f"http://spam.y{i}.org/" + "/".join(f"dir{j}" for j in range(30) if (i * 7 + j) % 11) for i in range(40)]
    urls = [long] * 50 + near + ["http://good.org/part1/dir2"] + [f"http://fine{i}.org/a" for i in range(30)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r.page_id: r for r in U.judge(pages).collect()}
    assert len(rows) == len(urls) and all(rows[i].verdict == "block" for i in range(90)) and rows[91].verdict == "allow"
    one = U.judge(spark.createDataFrame([(1, long)], "page_id long, url string")).first()
    assert one.verdict == "allow" and one.mined is None  # a url seen once makes no rule


def test_labels_of_the_caller(spark):
    urls = [f"http://h{i}.org/shop/cheap/{i}" for i in range(40)] + [f"http://g{i}.org/shop/{i}" for i in range(40)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(u, "block") for u in urls[:38]], "url string, label string")
    rows = U.judge(pages, labels=labels).collect()
    assert {r.page_id for r in rows if r.verdict == "block"} == set(range(40))


def test_sure_tokens_are_rules_by_themselves(spark):
    rng = random.Random(8)
    rows = []
    for i in range(240):
        tokens = {f"q:{rng.choice('abcdef')}" for _ in range(rng.randint(1, 6))}
        bad = {"q:a", "q:b"} <= tokens or i % 9 == 0
        tokens |= {f"h:{x}" for x in "xyz" if bad and rng.random() < 0.4}
        rows.append((sorted(tokens), "block" if bad else "open"))
    df = spark.createDataFrame(rows, "tokens array<string>, label string")
    got = {tuple(r.tokens): r.confidence for r in U.mined_rules(df, 0.03, 0.9, 5).collect()}
    want = plain_rules(rows, 0.03, 0.9, 5)
    assert ("h:x",) in want and ("q:a", "q:b") in want and got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in want)


def test_many_sure_parameters(spark):
    rng = random.Random(1)
    names = [f"p{i}" for i in range(150)]
    urls = ["http://casino.b%d.com/x?%s" % (i, "&".join(f"{p}={i}" for p in rng.sample(names, 100))) for i in range(200)] + [f"http://ok{i}.com/z" for i in range(300)]
    rows = {r.page_id: r for r in U.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert len(rows) == 500 and all(rows[i].verdict == ("block" if i < 200 else "allow") for i in rows)
