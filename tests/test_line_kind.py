"""Lines are classified as Python's JSON reader does it, without Python."""

import json
import random

from pyspark.sql import functions as F

from placeloom.sources import tables


def plain(line):
    if not line.strip():
        return "blank"
    try:
        return "record" if isinstance(json.loads(line), dict) else "malformed"
    except (ValueError, RecursionError):
        return "malformed"


LINES = [
    "", " ", "\t", " ", "\x0b", "{}", " {} ", "[]", "1", "null", '"{}"', "nan", '{"a":1}', '{"a":1} x', '{"a":1}{"b":2}', '{"a":1},{"b":2}', '{"a":1}, 0]', '{"a":1}, 0], {}', '{"a":1}]', '{"a":1}]}', '{"a":1},0]}', '{"a":1}],[{}',
    '{"a":1,"a":2}', '{"a":NaN}', '{"a":[-Infinity,Infinity, NaN ]}', '{"a":-NaN}', '{"a":NaN NaN}', '{NaN:1}', '{"NaN":"x: NaN, y"}', '{"a":Nan}', '{"a":"x\\u00e9\\n"}', '{"a":"\\x"}', '{"a":"b}', "{'a':1}", "{a:1}", '{"a":1,}', '{"a":01}', '{"a":1.}', '{"a":.5}',
    '{"a":1e400}', '{"a":+1}', '{"a":0x1}', '{"a":"\t"}', '{"a":"\\ud800"}', '{"a":tru}', '{"a":true}', "// c", '{"a":1} // c', '{"a":/* c */1}', '﻿{"a":1}', '\xa0{"a":1}', "{" * 50, '{"a":' * 50 + "1" + "}" * 50, '{"é":"漢"}', '{"a" :\r1}', '{"":""}', '{"a":[1,2}', '{"a":1}\x00', "]", "]{}", ",{}", "{},", "{}]", "}", "{",
]


def mutated(n=3000):
    rng = random.Random(6)
    seeds = [x for x in LINES if len(x) < 60 and "{" in x]
    parts = ['"', "{", "}", "[", "]", ",", ":", " ", "0", "NaN", "a", "\\", "-", "1e5", "null"]
    for _ in range(n):
        s = list(rng.choice(seeds))
        for _ in range(rng.randint(1, 3)):
            at = rng.randint(0, len(s))
            s[at : at + rng.randint(0, 2)] = [rng.choice(parts)] * rng.randint(0, 2)
        yield "".join(s)


def test_same_as_python(spark):
    lines = [*LINES, *mutated()]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").select("i", tables.line_kind(F.col("line")).alias("kind"))
    wrong = [(lines[r.i], r.kind) for r in df.collect() if r.kind != plain(lines[r.i])]
    assert wrong == []


def test_no_python_in_the_plan(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a":1}\n\n[1]\n{"a":2} x\n{"a":3}\n')
    lines, seen = tables.counted_lines(tables.json_lines(spark, str(tmp_path / "a.json")))
    assert "Python" not in lines._jdf.queryExecution().toString() and "Arrow" not in lines._jdf.queryExecution().toString()
    assert [r.a for r in tables.json_records(lines, "a int").collect()] == [1, 3]
    assert seen.get == {"total_lines": 5, "records": 2, "malformed_lines": 2} == tables.line_counts(tables.json_lines(spark, str(tmp_path / "a.json"))).first().asDict()
    assert tables.json_lines(spark, str(tmp_path / "none")).count() == 0
