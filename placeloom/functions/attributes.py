"""Attribute maps of businesses: flattening, labels and descriptions.

Attributes and hours are JSON text at rest; a value that is no JSON object counts as empty.
Values that are Python dict literals (``{'garage': False}``) are read by ``literal_map`` after
turning the three literal names into JSON; ``literal_json`` reads any nested literal of texts, plain
numbers and the three names. What that leaves out (tuples, sets, exponents, odd escapes, repeated keys)
is read by ``python_literals``, a pandas UDF; ``with_literals`` puts it into a plan only if it is needed.
"""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import joined, let, one_json

MAP = "map<string,string>"
#: Attribute families that are promoted to columns (fixed values).
SELECTED = ("Ambience", "BusinessParking", "GoodForKids", "OutdoorSeating", "RestaurantsDelivery", "RestaurantsPriceRange2", "RestaurantsReservations", "RestaurantsTakeOut", "WiFi")


def _empty() -> Column:
    return F.create_map().cast(MAP)


def as_map(text: Column) -> Column:
    """JSON object text as a map; anything else is an empty map."""
    return F.coalesce(F.when(F.trim(text).startswith("{"), F.from_json(text, MAP)), _empty())


def sorted_json(values: Column) -> Column:
    """A map as JSON text with its keys in order; null gives an empty object."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(values, _empty())))))


def literal_map(value: Column) -> Column:
    """A Python dict literal of plain values as a map, or null."""
    text = F.trim(value)
    for name, json_name in (("False", "false"), ("True", "true"), ("None", "null")):
        text = F.regexp_replace(text, rf"(?<=[:\s\[,]){name}(?=[\s,}}\]])", json_name)
    return F.when(text.startswith("{"), F.from_json(text, MAP, {"allowSingleQuotes": "true"}))


def flattened(attributes: Column, prefix: str = "attr_") -> Column:
    """Selected attributes as one flat map: scalars under their key, literal maps under key_child."""
    chosen = F.filter(F.map_entries(F.coalesce(attributes, _empty())), lambda e: e["key"].isin(*SELECTED))
    nested = lambda e: literal_map(e["value"])
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    flat = F.transform(
        chosen,
        lambda e: F.when(
            nested(e).isNotNull(),
            F.transform(F.map_entries(nested(e)), lambda c: pair(F.concat(F.lit(prefix), e["key"], F.lit("_"), c["key"]), c["value"])),
        ).otherwise(F.array(pair(F.concat(F.lit(prefix), e["key"]), e["value"]))),
    )
    return F.map_from_entries(F.array_distinct(F.flatten(flat)))


#: Tokens of a literal: texts, whole numbers, fractions that Python writes as they stand, names, marks, spaces.
_TEXT = r"""[uU]?'[^'\\\x00-\x1f]*(?:\\[\\ntr'"][^'\\\x00-\x1f]*)*'|[uU]?"[^"\\\x00-\x1f]*(?:\\[\\ntr'"][^"\\\x00-\x1f]*)*\""""
_NUMBER = r"(?<![\w.])(?:-?(?:0|[1-9][0-9]{0,7})\.(?:[0-9]{0,3}[1-9]|0)|-?[1-9][0-9]{0,36}|0)(?![\w.])"
_TOKEN = rf"{_TEXT}|{_NUMBER}|\b(?:True|False|None)\b|[{{}}\[\]:,]| "


def _json_token(token: Column) -> Column:
    body = F.regexp_extract(token, r"(?s)^[uU]?.(.*).$", 1)
    fewer = F.regexp_replace(body, r"""(\\[\\ntr"])|\\(')""", "$1$2")  # a single quote needs no escape in JSON
    text = F.concat(F.lit('"'), F.regexp_replace(fewer, r"""\G([^"\\]*+(?:\\.[^"\\]*+)*+)\"""", r'$1\\"'), F.lit('"'))
    plain = F.when(token == "True", "true").when(token == "False", "false").when(token == "None", "null").otherwise(token)
    return F.when(token.rlike("""^[uU]?['"]"""), text).otherwise(plain)


def literal_json(value: Column) -> Column:
    """A Python dict or list literal as JSON text, as ``json.dumps`` writes it; null for what is none and for
    what only Python reads."""
    # deep nesting and many escapes are left to Python
    small = (F.length(F.regexp_replace(value, r"[^\[{]", "")) < 90) & (F.length(F.regexp_replace(value, r"[^\\]", "")) < 200)
    known = value.rlike(r"^ *[{\[]") & small & (F.regexp_replace(value, _TOKEN, "") == "")
    marked = lambda t: F.when(t.isin(":", ","), F.concat(t, F.lit(" "))).otherwise(t)
    read = lambda tokens: F.when(let(F.array_join(tokens, ""), one_json), F.array_join(F.transform(F.filter(tokens, lambda t: t != " "), marked), ""))
    tokens = F.transform(F.regexp_extract_all(value, F.lit(_TOKEN), F.lit(0)), _json_token)
    return F.when(F.coalesce(known, F.lit(False)), let(tokens, read))


def with_literals(df: DataFrame, column: str, into: str) -> DataFrame:
    """``df`` with the literals of a column as JSON text, other values unchanged. Whether a value is left
    to Python is found by a pass over the column; without one the plan has no Python in it."""
    text = F.col(column).cast("string")
    left = F.when(literal_json(text).isNull() & text.rlike(r"(?U)^[\s\x1c-\x1f]*[{\[]"), text)
    if df.filter(left.isNotNull()).isEmpty():
        return df.withColumn(into, F.coalesce(literal_json(text), text))
    return df.withColumn(into, F.coalesce(literal_json(text), python_literals(left), text))


@F.pandas_udf(T.StringType())
def python_literals(values: pd.Series) -> pd.Series:
    """Python dict and list literals as JSON text; other values, and what does not parse, unchanged."""

    def one(v):
        if not isinstance(v, str) or not v.strip().startswith(("{", "[")):
            return v
        try:
            read = json.dumps(ast.literal_eval(v), ensure_ascii=False, default=str)
            return read if read.encode() else v  # half a surrogate pair is no text
        except (TypeError, ValueError, SyntaxError, MemoryError, RecursionError):
            return v

    return values.map(one)


def populated(attributes: Column) -> Column:
    """Without values that are null, empty or the text None."""
    return F.map_filter(F.coalesce(attributes, _empty()), lambda k, v: v.isNotNull() & ~v.isin("", "None"))


def dimension_labels(attributes: Column, hours: Column) -> Column:
    """Sorted names of populated attributes, and ``hours`` if there are any."""
    some_hours = F.when(F.size(F.coalesce(hours, _empty())) > 0, F.array(F.lit("hours"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(F.map_keys(populated(attributes)), some_hours)))


def _pairs(values: Column, sep: str, most: int | None = None) -> Column:
    entries = F.array_sort(F.map_entries(F.coalesce(values, _empty())))
    if most:
        entries = F.slice(entries, 1, most)
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(sep), F.coalesce(e["value"], F.lit("None")))), ", ")


def description(name: Column, cats: Column, city: Column, state: Column, stars: Column, attributes: Column, hours: Column) -> Column:
    """One line: name, categories, city, state, rating, the first five attributes, and hours."""
    rating = F.when(stars.isNotNull(), F.concat(F.lit("rated "), stars.cast("string")))
    open_at = F.when(F.size(F.coalesce(hours, _empty())) > 0, F.concat(F.lit("hours: "), _pairs(hours, " ")))
    return joined(" | ", name, F.array_join(cats, ", "), city, state, rating, _pairs(attributes, ": ", 5), open_at)
