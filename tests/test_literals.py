"""Literals as JSON text: equal to Python's reader on generated and odd values."""

import ast
import json
import random

from pyspark.sql import functions as F

from placeloom.functions import attributes as A

ODD = [
    None, "", " ", "x", "{", "[", "{}", "[]", " {}", "{} ", "\t{}", "{}\n", "[1] [2]", "[1],[2]", "[1][0]", "[1, 2,]", "{'a': 1,}", "(1, 2)", "[(1, 2)]", "{1, 2}", "{1: 2}", "{'a': 1, 'a': 2}", "['a' 'b']", "[1 2]", "[007]", "[0]", "[-0]", "[-0.0]", "[00]",
    "[1.50]", "[1.5]", "[1.]", "[.5]", "[0.00001]", "[0.0001]", "[123456789.5]", "[1e5]", "[1_000]", "[0x1F]", "[1-5]", "[-5]", "[- 5]", "[+5]", "[1j]", "[True]", "[true]", "[Truely]", "[None, False]", "[-True]", "[b'x']", "[r'\\n']", "[f'x']", "[u'x', U\"y\"]", "['''a''']",
    "['it\\'s']", '["it\\"s"]', "['say \"hi\"']", "['\\\\']", "['\\\\\\'']", "['\\\\\"']", "['a\\nb\\tc\\r']", "['\\x41']", "['\\u00e9']", "['\\q']", "['\n']", "['\x7f\u2028é中😀']", "['a\\\nb']", "[" * 95 + "]" * 95, "{'a': {'b': [1, {'c': None}]}}", "[nan]", "[1] # x", "{'a':1}", "{ 'a' :1 , 'b':[ ] }",
    "{'a': '" + "x" * 9000 + "'}", "['" + "\\'" * 300 + "']", "[" + "9" * 40 + "]", "['a\\/b']", "\u3000[1]", "['$1 \\\\ $2']", "{'k': 'a', \"k\": 2}", "[1,,2]", "[:]", "{'a' 1}", "['\x00']", "[1], 2],[3", "[1], 2, 3],[4", "{[1]: 2}", "{[1], 2}", "{(1, 2): 3}", "['\\ud800']",
]


def wanted(v):
    if v is None or not v.strip().startswith(("{", "[")):
        return v
    try:
        read = json.dumps(ast.literal_eval(v), ensure_ascii=False, default=str)
        return read if read.encode() else v
    except (TypeError, ValueError, SyntaxError, MemoryError, RecursionError):
        return v


def value(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 6)
    if kind == 0:
        return rng.choice([None, True, False])
    if kind == 1:
        return rng.randrange(-(10 ** rng.randrange(1, 20)), 10**9)
    if kind == 2:
        return round(rng.uniform(-1000, 1000), rng.randrange(1, 8))
    if kind < 6:
        return "".join(rng.choice("ab'\"\\ \n\té中{}[]:,Tru") for _ in range(rng.randrange(8)))
    items = [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return items if kind == 6 else tuple(items) if kind == 7 else {f"{rng.choice(['k', 'a b', chr(39)])}{i}": x for i, x in enumerate(items)}


def mutated(rng, text):
    at = rng.randrange(len(text) + 1)
    return text[:at] + rng.choice(["'", '"', ",", " ", "\\", "]", "1", "u", ""]) + text[at + rng.randrange(2) :]


def test_literals_are_read_as_python_does(spark):
    rng = random.Random(4)
    texts = [repr([value(rng)]) if i % 2 else repr({"a": value(rng)}) for i in range(1500)]
    texts += [mutated(rng, t) for t in texts] + ODD
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r.i: (r.fast, r.j) for r in A.with_literals(df, "t", "j").withColumn("fast", A.literal_json(F.col("t"))).collect()}
    wrong = [(t, got[i][1], wanted(t)) for i, t in enumerate(texts) if got[i][1] != wanted(t)]
    assert not wrong, wrong[:5]
    wrong = [(t, got[i][0]) for i, t in enumerate(texts) if got[i][0] is not None and got[i][0] != wanted(t)]
    assert not wrong, wrong[:5]
    fast = sum(got[i][0] is not None for i in range(1500))
    assert fast > 700


def test_no_python_in_the_plan_if_none_is_needed(spark):
    plain = spark.createDataFrame([("{'a': u'it', 'b': [True, None, 1.5]}",), ("no literal",), (None,)], "v string")
    out = A.with_literals(plain, "v", "j")
    assert [r.j for r in out.collect()] == ['{"a": "it", "b": [true, null, 1.5]}', "no literal", None]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r.j for r in A.with_literals(plain.union(spark.createDataFrame([("[(1, 2)]",)], "v string")), "v", "j").collect()][-1] == "[[1, 2]]"
