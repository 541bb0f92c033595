"""Text expressions. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, as Unicode has it, with the four information separators.
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_SYMBOLS = r"^[^\p{L}\p{N}]+$"


def strip(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, _EDGES, "")


def has_value(col: Column) -> Column:
    """Neither null nor empty. For ids, which are text here."""
    return col.isNotNull() & (col != "")


def symbols_only(text: Column) -> Column:
    """Characters, but no letter or number of any script among them."""
    return text.rlike(_SYMBOLS)


def categories(text: Column) -> Column:
    """A comma list as an array: stripped, lower-cased, without empty entries; null gives an empty array."""
    parts = F.transform(F.split(text, ","), lambda x: F.lower(strip(x)))
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def category_list(values: Column) -> Column:
    """The same for an array."""
    parts = F.transform(values, lambda x: F.lower(strip(x)))
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def ascii_tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores, lower-cased."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9_]+"), 0), F.lower)


def first_upper(text: Column) -> Column:
    """First character upper-cased, all others lower-cased."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def let(value: Column, then) -> Column:
    """``then(value)``, with the value made once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def one_json(text: Column) -> Column:
    """Whether a text is one JSON value with nothing after it and no key twice. As an element of an array it
    has one element after it, and then two: it does not close the array itself."""
    longer = lambda after: F.json_array_length(F.concat(F.lit("["), text, F.lit(after)))
    return F.coalesce((longer(",0]") == 2) & (longer(",0,0]") == 3) & F.try_parse_json(text).isNotNull(), F.lit(False))


def joined(sep: str, *cols: Column) -> Column:
    """What is not empty, joined."""
    return F.concat_ws(sep, *[F.nullif(c, F.lit("")) for c in cols])
