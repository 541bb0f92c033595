"""Model output: fences, normalised fields, requests and the answer without a model.

Expressions where Spark has them. ``json_responses`` reads answers as variants; what only Python writes
as text in the same way (fractions and nested values in text fields, keys that occur twice, NaN) is left to
``parsed_responses``, a pandas UDF over ``json``, which ``with_responses`` puts into a plan only if it is needed.
"""

from __future__ import annotations

import base64
import json
import mimetypes
from pathlib import Path
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let, one_json, strip

LIST_FIELDS = ("style", "ocr_text", "location_clues", "travel_intent")
TEXT_FIELDS = ("merchant_type", "poi_type", "scene")
_LIST = T.ArrayType(T.StringType())
STRUCTURED = T.StructType([T.StructField("objects", _LIST), *[T.StructField(n, T.StringType()) for n in TEXT_FIELDS], *[T.StructField(n, _LIST) for n in LIST_FIELDS]])
RESPONSE = T.StructType([T.StructField("image_summary", T.StringType()), T.StructField("structured_info", STRUCTURED), T.StructField("confidence", T.DoubleType()), T.StructField("raw_model_output", T.StringType())])
#: Wording is ours; the field names are the contract.
PROMPTS = {
    "prompt_image_understanding_v1": "Look at the images as a travel searcher would. Answer with one JSON object that has objects, merchant_type, poi_type, scene, style, ocr_text, location_clues, travel_intent, confidence and image_summary.",
}
#: Answers without a model (fixed values).
MUSEUM = {
    "image_summary": "Image likely shows a museum or cultural attraction.",
    "objects": ["building", "exhibition", "indoor space"], "merchant_type": "museum", "poi_type": "attraction", "scene": "museum exhibition",
    "style": ["cultural", "educational"], "ocr_text": [], "location_clues": [], "travel_intent": ["museum visit", "city walk"], "confidence": 0.62,
}
CAFE = {
    "image_summary": "Image likely shows a cozy cafe scene suitable for OTA visual search.",
    "objects": ["coffee", "table", "indoor seating"], "merchant_type": "cafe", "poi_type": "food_and_drink", "scene": "indoor cafe",
    "style": ["cozy", "minimal", "warm lighting"], "ocr_text": [], "location_clues": [], "travel_intent": ["coffee break", "afternoon tea", "solo work"], "confidence": 0.78,
}


def without_fence(text: Column) -> Column:
    """Without a leading fence line and a trailing fence, stripped."""
    bare = strip(text)
    opened = F.regexp_replace(bare, r"^```[^\n\r]*(\r\n|\n|\r|$)", "")
    closed = F.regexp_replace(opened, r"(^|\r\n|\n|\r)[ \t]*```[ \t]*$", "")
    return F.when(bare.startswith("```"), strip(closed)).otherwise(bare)


def as_list(json_text: Column) -> Column:
    """JSON text of an array, scalar or null as an array of text."""
    return (
        F.when(json_text.isNull() | (json_text == "null"), F.array().cast("array<string>"))
        .when(json_text.startswith("["), F.from_json(json_text, "array<string>"))
        .otherwise(F.array(F.regexp_replace(json_text, r'^"|"$', "")))
    )


def _answer(found: dict) -> Column:
    lits = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    info = [lits(found[k]).alias(k) if isinstance(found[k], list) else F.lit(found[k]).alias(k) for k in ("objects", "merchant_type", "poi_type", "scene", *LIST_FIELDS)]
    return F.struct(F.lit(found["image_summary"]).alias("image_summary"), F.struct(*info).alias("structured_info"), F.lit(found["confidence"]).alias("confidence"))


def answer_without_model(image_urls: Column, user_text: Column) -> Column:
    """The museum record if the urls or the text speak of one, else the cafe record."""
    everything = F.lower(F.concat_ws(" ", image_urls, F.coalesce(user_text, F.lit(""))))
    return F.when(everything.contains("museum"), _answer(MUSEUM)).otherwise(_answer(CAFE))


def prompt(version: Column, prompts: dict[str, str] = PROMPTS) -> Column:
    """The prompt of a version; unknown versions get the first."""
    known = F.create_map(*[F.lit(x) for p in prompts.items() for x in p])
    return F.coalesce(known[version], F.lit(next(iter(prompts.values()))))


def chat_payload(model: Column, prompt_text: Column, user_text: Column, image_urls: Column) -> Column:
    """The request body of an OpenAI-style chat endpoint as JSON text."""
    part = "struct<type:string,text:string,image_url:struct<url:string>>"
    text = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url")).cast(part)
    images = F.transform(image_urls, lambda u: F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(u.alias("url")).alias("image_url")).cast(part))
    said = F.when(user_text.isNotNull() & (user_text != ""), F.array(text(user_text))).otherwise(F.array().cast(f"array<{part}>"))
    content = F.concat(F.array(text(prompt_text)), said, images)
    return F.to_json(F.struct(model.alias("model"), F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("messages"), F.lit(0.1).alias("temperature"), F.lit(0.9).alias("top_p"), F.lit(512).alias("max_tokens")))


def object_labels(value) -> list[str]:
    """Labels of detections: text as it is, objects by type, name or label."""
    labels = []
    for item in value if isinstance(value, list) else [value]:
        if isinstance(item, dict):
            item = next((item[k] for k in ("type", "name", "label") if item.get(k)), None)
        if item is not None:
            labels.append(str(item))
    return labels


def listed(value) -> list[str]:
    return [] if value is None else [str(x) for x in value] if isinstance(value, list) else [str(value)]


def bare(text: str) -> str:
    """``without_fence`` for one text."""
    text = text.strip()
    if text.startswith("```"):
        lines = text.splitlines()[1:]
        if lines and lines[-1].strip() == "```":
            lines.pop()
        text = "\n".join(lines).strip()
    return text


def normalised(content: str | None) -> dict | None:
    """A model's answer in the stable shape. No JSON: the text is the summary, confidence 0.3. A JSON
    value that is no object is treated like no JSON."""
    if content is None:
        return None
    try:
        data = json.loads(bare(content))
    except ValueError:
        data = None
    none = {k: [] for k in ("objects", *LIST_FIELDS)} | dict.fromkeys(TEXT_FIELDS)
    if not isinstance(data, dict):
        return {"image_summary": content, "structured_info": none, "confidence": 0.3, "raw_model_output": content}
    info = data.get("structured_info", data)
    info = info if isinstance(info, dict) else {}
    shaped = {k: None if info.get(k) is None else str(info[k]) for k in TEXT_FIELDS}
    shaped |= {k: listed(info.get(k)) for k in LIST_FIELDS} | {"objects": object_labels(info.get("objects", []))}
    try:
        sure = float(data.get("confidence", 0.5))
    except (TypeError, ValueError):
        sure = 0.5
    return {"image_summary": str(data.get("image_summary") or ""), "structured_info": shaped, "confidence": sure, "raw_model_output": content}


@F.pandas_udf(RESPONSE)
def parsed_responses(contents: pd.Series) -> pd.DataFrame:
    rows = [normalised(c) or {} for c in contents]
    none = dict.fromkeys(STRUCTURED.names)
    out = pd.DataFrame({k: [r.get(k) for r in rows] for k in ("image_summary", "confidence", "raw_model_output")})
    out.insert(1, "structured_info", [r.get("structured_info") or none for r in rows])
    return out


#: Kinds of values whose text is the same for Spark and Python, but for the case of booleans.
_PLAIN = ("STRING", "BIGINT", "BOOLEAN")


def _get(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _kind(value: Column) -> Column:
    """The kind of a variant; a value that is missing has the kind of a null."""
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _said(value: Column) -> Column:
    text = _get(value, "$", "string")
    return F.when(_kind(value) == "BOOLEAN", F.initcap(text)).when(_kind(value) == "VOID", "None").otherwise(text)


def _label(value: Column) -> Column:
    """A detection's label, or null."""
    named = F.coalesce(*[F.nullif(_get(value, f"$.{k}", "string"), F.lit("")) for k in ("type", "name", "label")])
    return F.when(_kind(value).startswith("OBJECT"), named).when(_kind(value) != "VOID", _said(value))


def _label_known(value: Column) -> Column:
    parts = [_kind(_get(value, f"$.{k}")).isin("STRING", "VOID") for k in ("type", "name", "label")]
    return _kind(value).isin(*_PLAIN, "VOID") | (_kind(value).startswith("OBJECT") & parts[0] & parts[1] & parts[2])


def _items(value: Column) -> Column:
    """An array's values; another value as an array of one; none for a null."""
    none = F.array().cast("array<variant>")
    return F.coalesce(F.when(_kind(value).startswith("ARRAY"), _get(value, "$", "array<variant>")).when(_kind(value) != "VOID", F.array(value)), none)


def _shaped(content: Column, parts: Column) -> Column:
    """The stable shape of an answer's parts (variants), or null if it is left to Python."""
    sure, summary = parts["confidence"], parts["image_summary"]
    known = _kind(summary).isin("STRING", "VOID") & ((_kind(sure) != "STRING") | _get(sure, "$", "string").rlike(r"^-?[0-9]{1,15}(\.[0-9]{1,15})?$"))
    for k in TEXT_FIELDS:
        known &= _kind(parts[k]).isin(*_PLAIN, "VOID")
    for k in LIST_FIELDS:
        known &= F.forall(_items(parts[k]), lambda x: _kind(x).isin(*_PLAIN, "VOID"))
    known &= F.forall(_items(parts["objects"]), _label_known)
    number = F.when(_kind(sure).rlike("^(BIGINT|DECIMAL|DOUBLE|BOOLEAN|STRING)"), _get(sure, "$", "double"))
    info = [F.filter(F.transform(_items(parts["objects"]), _label), lambda x: x.isNotNull()).alias("objects")]
    info += [F.when(_kind(parts[k]) != "VOID", _said(parts[k])).alias(k) for k in TEXT_FIELDS]
    info += [F.transform(_items(parts[k]), _said).alias(k) for k in LIST_FIELDS]
    read = F.struct(F.coalesce(_get(summary, "$", "string"), F.lit("")).alias("image_summary"), F.struct(*info).alias("structured_info"), F.coalesce(number, F.lit(0.5)).alias("confidence"), content.alias("raw_model_output"))
    return F.when(known, read.cast(RESPONSE))


def _parts(data: Column, info: Column) -> Column:
    own = [_get(data, f"$.{k}").alias(k) for k in ("image_summary", "confidence")]
    return F.struct(*own, *[_get(info, f"$.{k}").alias(k) for k in ("objects", *TEXT_FIELDS, *LIST_FIELDS)])


def json_responses(content: Column) -> Column:
    """``normalised`` for answers in which no text depends on how Python writes a value; null for others."""

    def of_data(data: Column) -> Column:
        inner = _get(data, "$.structured_info")
        return let(_parts(data, F.when(inner.isNull(), data).otherwise(inner)), lambda parts: _shaped(content, parts))

    # other line ends than the usual ones, and halves of surrogate pairs, are left to Python
    usual = ~content.rlike(r"[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]|\\u[dD][89a-fA-F]")
    data = let(without_fence(content), lambda text: F.when(usual & text.rlike(r"^[ \t\r\n]*\{") & one_json(text), F.try_parse_json(text)))
    read = let(data, lambda d: F.when(d.isNotNull(), of_data(d)))
    none = lambda kind: F.lit(None).cast(kind)
    empty = F.array().cast(_LIST)
    blank = lambda lists: F.struct(lists.alias("objects"), *[none("string").alias(k) for k in TEXT_FIELDS], *[lists.alias(k) for k in LIST_FIELDS])
    missing = F.struct(none("string"), blank(none(_LIST)), none("double"), none("string"))
    # without a brace there is no object
    said = F.struct(content, blank(empty), F.lit(0.3), content)
    return F.when(content.isNull(), missing.cast(RESPONSE)).when(~content.contains("{"), said.cast(RESPONSE)).otherwise(read)


def with_responses(df: DataFrame, column: str, into: str) -> DataFrame:
    """``df`` with the answers of a column in the stable shape. Whether an answer is left to Python is found by
    a pass over the column; without one the plan has no Python in it. A confidence that is NaN is null."""
    content = F.col(column).cast("string")
    read = json_responses(content)
    left = F.when(read.isNull(), content)
    if df.filter(left.isNotNull()).isEmpty():
        return df.withColumn(into, read)
    return df.withColumn(into, F.coalesce(read, parsed_responses(left)))


def file_url_path(url: str) -> str:
    """The path that a file url names: POSIX, relative, with a host, or with a drive letter."""
    parsed = urlparse(url)
    path = unquote(parsed.path)
    if parsed.netloc not in ("", "localhost"):
        return parsed.netloc + path
    return path[1:] if len(path) >= 3 and path[0] == "/" and path[2] == ":" else path


def embedded_image(url: str) -> str:
    """A file url of an existing file as a data url; any other url unchanged."""
    if not url.startswith("file://"):
        return url
    path = Path(file_url_path(url))
    if not path.is_file():
        return url
    kind = mimetypes.guess_type(path.name)[0] or "application/octet-stream"
    return f"data:{kind};base64,{base64.b64encode(path.read_bytes()).decode()}"
