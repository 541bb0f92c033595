"""Model answers read as variants: equal to Python's reader on generated and odd answers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from placeloom.functions import modelout as M

ODD = [
    None, "", "plain", "[]", "[1]", "{", "{}", " {} ", "{}{}", "{},1", "{},1],[2", "```json\n{}\n```", "```\n{\"scene\": \"x\"}\n```", "```\r\n{\"scene\": \"x\"}\r\n  ```  ", "``` {}", "```json\n{}", "```", '{"a": NaN}', '{"scene": "a", "scene": "b"}', '{"scene": 1.0}', '{"scene": 1e3}', '{"scene": true}',
    '{"scene": 12345678901234567890}', '{"scene": -0}', '{"scene": {"a": 1}}', '{"scene": ["a"]}', '{"style": null}', '{"style": "x"}', '{"style": 5}', '{"style": [null, true, 7, "y"]}', '{"style": [1.5]}', '{"style": {"a": 1}}', '{"style": [["a"]]}', '{"objects": null}', '{"objects": "cup"}',
    '{"objects": {"name": "cup"}}', '{"objects": [{"type": "", "name": "n"}, {"type": null, "label": "l"}, {"other": 1}, null, 3, false, "t"]}', '{"objects": [{"type": 5}]}', '{"objects": [{"type": ["a"]}]}', '{"confidence": "0.7"}', '{"confidence": "high"}', '{"confidence": " 1e-1 "}', '{"confidence": true}',
    '{"confidence": null}', '{"confidence": [1]}', '{"confidence": 1e400}', '{"confidence": 0.1}', '{"confidence": 3}', '{"confidence": "nan"}', '{"image_summary": 5}', '{"image_summary": false}', '{"image_summary": null}', '{"image_summary": ""}', '{"structured_info": null, "scene": "out"}',
    '{"structured_info": [], "scene": "out"}', '{"structured_info": "x"}', '{"structured_info": {"scene": "in", "objects": ["o"]}, "scene": "out", "confidence": 0.9, "image_summary": "s"}', "{'scene': 'x'}", '{"scene": "a\nb"}', '{"scene": "a\tb"}', '{"scene": "a\\nb\\u00e9"}', '{"scene": "é中😀"}', '﻿{"scene": "x"}',
    '　{"scene": "x"} ', '```json {"scene": "x"} ```', '{"scene": "x",}', '{"scene": "x"} trailing', 'Here: {"scene": "x"}', '{"SCENE": "x"}', '{"scene": "\\ud83d\\ude00"}', '{"scene": "' + "y" * 5000 + '"}', "{" * 50,
]


def thing(rng, depth=0):
    kind = rng.randrange(10 if depth < 2 else 6)
    if kind < 3:
        return rng.choice(["", "cup", 'say "x"', "é\n", "{", "None"])
    if kind < 6:
        return rng.choice([None, True, False, 0, 7, -3, 10**12, 0.5, 1.0, 2e-7])
    if kind < 8:
        return [thing(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["type", "name", "label", "z"]): thing(rng, depth + 1) for _ in range(rng.randrange(3))}


def answer(rng):
    names = rng.sample(["objects", *M.TEXT_FIELDS, *M.LIST_FIELDS], 4)
    info = {k: thing(rng) if rng.random() < 0.4 else ["a", "b"] if k in M.LIST_FIELDS else "word" for k in names}
    data = {"image_summary": thing(rng) if rng.random() < 0.2 else "sum", "confidence": thing(rng) if rng.random() < 0.3 else 0.83}
    data |= {"structured_info": info} if rng.random() < 0.5 else info
    text = json.dumps(data, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
    return f"```json\n{text}\n```" if rng.random() < 0.3 else text


def shown(row):
    return None if row is None else repr(row.asDict(recursive=True) if hasattr(row, "asDict") else row)


def wanted(content):
    blank = dict.fromkeys(M.STRUCTURED.names)
    found = M.normalised(content) or {"image_summary": None, "structured_info": blank, "confidence": None, "raw_model_output": None}
    if found["confidence"] != found["confidence"]:
        found["confidence"] = None
    return repr({k: {n: found[k][n] for n in M.STRUCTURED.names} if k == "structured_info" else found[k] for k in M.RESPONSE.names})


@pytest.mark.parametrize("python", [False, True])
def test_answers_are_read_as_python_does(spark, python):
    rng = random.Random(6)
    texts = [answer(rng) for _ in range(700)] + ODD
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    out = M.with_responses(df, "t", "r") if python else df.withColumn("r", M.json_responses(F.col("t")))
    got = {r.i: shown(r.r) for r in out.collect()}
    wrong = [(t, got[i], wanted(t)) for i, t in enumerate(texts) if (python or got[i] is not None) and got[i] != wanted(t)]
    assert not wrong, (len(wrong), *wrong[0])
    assert sum(got[i] is not None for i in range(700)) > 250


def test_no_python_in_the_plan_if_none_is_needed(spark):
    df = spark.createDataFrame([('{"scene": "bar", "objects": ["cup"]}',), ("words",), (None,)], "t string")
    out = M.with_responses(df, "t", "r")
    assert [r.r and (r.r.structured_info.scene, r.r.confidence) for r in out.collect()] == [("bar", 0.5), (None, 0.3), (None, None)]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
