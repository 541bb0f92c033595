"""Statistics that add up: counts, sums and extremes for each part of a table, kept as a table.

``tallies`` reads a table once. What it finds has a row for each measure (``what``) and each of its
values: how many (``n``), and for numbers their sum, least and greatest; ``first`` is the place of a
value's first occurrence. Rows are summed up in the tasks before they are shuffled. ``summed`` adds
tallies of parts, which gives the same as tallies of the whole, so that a table that grows by files
is not read again: ``add_files`` reads those that no earlier call has read. Distinct and top values are
exact, from the counts; a sketch would be smaller, but would not give the same figures.

A call writes a folder with the parts it has read. Folders that were not finished are passed over, and
their files are read again by the next call; files are taken to be immutable.

Edge cases: null and empty values are not counted; a null number is no number; an empty table has
no tallies, and its figures are zeros and nulls; names of further columns do not matter.
"""

from __future__ import annotations

import re
import uuid
from decimal import Decimal
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import has_value
from ..sources import tables

_ROWS = "rows"


#: Places in an array are below it.
_PLACES = Decimal(1 << 31)


def _packed(o: Column, kind: T.DataType) -> Column:
    """A place added to it gives a number that orders as (o, place) does."""
    return o.cast("decimal(20,0)") * _PLACES if isinstance(kind, T.IntegralType) else F.lit(None)


def _least(o: Column, p: Column, packed: Column, kind: T.DataType) -> Column:
    """The least pair (o, p), an aggregate. A whole number and a place are packed into one decimal number
    for it: numbers are summed up by hashing, while a struct would have all rows sorted by what they are grouped by."""
    if not isinstance(kind, T.IntegralType):
        return F.min(F.when(o.isNotNull() & p.isNotNull(), F.struct(o.alias("o"), p.alias("p"))))
    least = F.min(F.when(p.isNotNull(), o))
    place = F.min(packed + p) - _packed(least, kind)
    return F.when(least.isNotNull(), F.struct(least.alias("o"), place.cast("int").alias("p")))


def tallies(df: DataFrame, values: dict[str, Column] | None = None, numbers: dict[str, Column] | None = None, order: str | None = None, order_type: str | T.DataType = "long", part: Column | None = None) -> DataFrame:
    """part, what, value, n, total, least, most, first.

    ``values`` are columns of text or of arrays of text, ``numbers`` are whole numbers. ``order`` is the
    column by which the first occurrence is told; without it ``first`` is null, of ``order_type``.

    A row's values stand in one array, measure after measure, then a null for the row and for each number.
    """
    values, numbers = values or {}, numbers or {}
    kinds = dict(df.select(*[c.alias(name) for name, c in values.items()]).dtypes)
    texts = [c if kinds[name].startswith("array") else F.array(c) for name, c in values.items()]
    lists = [F.coalesce(c.cast("array<string>"), F.array().cast("array<string>")).alias(f"v{i}") for i, c in enumerate(texts)]
    long = F.array(*[c.cast("long") for c in numbers.values()]).cast("array<bigint>")
    own = df.select((F.lit("") if part is None else part).cast("string").alias("part"), (F.lit(None) if order is None else F.col(order)).alias("o"), long.alias("numbers"), *lists)
    kind, n_lists = own.schema["o"].dataType, len(lists)
    ends = [F.lit(0)]  # where each measure's values start, and the last ones end
    for i in range(n_lists):
        ends.append(ends[-1] + F.size(f"v{i}"))
    more = F.array(*[F.lit(None).cast("string")] * (1 + len(numbers)))
    rows = own.select("part", "o", _packed(F.col("o"), kind).alias("packed"), "numbers", F.concat(*[f"v{i}" for i in range(n_lists)], more).alias("found"), *[e.alias(f"e{i}") for i, e in enumerate(ends)])
    # no array is empty; Spark would make the values once more to filter empty arrays for the inner form
    each = rows.select("part", "o", "packed", "numbers", *[f"e{i}" for i in range(n_lists + 1)], F.posexplode_outer("found").alias("at", "value"))
    what, place = F.col("at") - F.col(f"e{n_lists}") + n_lists, F.lit(None).cast("int")
    for i in reversed(range(n_lists)):
        here = F.col("at") < F.col(f"e{i + 1}")
        what, place = F.when(here, i).otherwise(what), F.when(here, F.col("at") - F.col(f"e{i}")).otherwise(place)
    number = F.get("numbers", F.col("at") - F.col(f"e{n_lists}") - 1)
    each = each.select("part", "o", "packed", what.alias("k"), "value", place.alias("p"), number.alias("number"))
    each = each.filter(has_value(F.col("value")) | (F.col("k") == n_lists) | F.col("number").isNotNull())
    none = F.when(F.lit(False), F.struct(F.lit(None).cast(order_type).alias("o"), F.lit(None).cast("int").alias("p")))
    first = none if order is None else _least(F.col("o"), F.col("p"), F.col("packed"), kind)
    found = each.groupBy("part", "k", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("number").alias("total"), F.min("number").alias("least"), F.max("number").alias("most"), first.alias("first"))
    names = F.array(*[F.lit(name) for name in [*values, _ROWS, *numbers]])
    return found.select("part", F.get(names, F.col("k")).alias("what"), "value", "n", "total", "least", "most", "first")


def renamed(counted: DataFrame, prefix: str) -> DataFrame:
    """Tallies whose measures carry the name of their table."""
    return counted.withColumn("what", F.concat(F.lit(f"{prefix}."), "what"))


def summed(counted: DataFrame) -> DataFrame:
    """what, value, n, total, least, most, first over all parts."""
    o, p, kind = F.col("first.o"), F.col("first.p"), counted.schema["first"].dataType["o"].dataType
    return counted.groupBy("what", "value").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), _least(o, p, _packed(o, kind), kind).alias("first"))


def figures(whole: DataFrame) -> DataFrame:
    """One row for each measure of ``summed``: n, distinct values, total, least, mean and most."""
    one = whole.groupBy("what").agg(F.sum("n").alias("n"), F.count("value").alias("distinct_values"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
    return one.withColumn("mean", F.col("total") / F.col("n"))


def top(whole: DataFrame, what: str, n: int = 20) -> DataFrame:
    """The most frequent values of a measure; ties by first occurrence, then by value."""
    return whole.filter((F.col("what") == what) & F.col("value").isNotNull()).orderBy(F.desc("n"), "first", "value").limit(n).select("value", "n")


def add_files(spark: SparkSession, folder: str, path: str, values: dict[str, Column] | None = None, numbers: dict[str, Column] | None = None, order: str | None = None) -> int:
    """Adds tallies of those Parquet files of ``folder`` that ``path`` has none of; returns how many. A part is a file."""
    done = {r.part for r in parts(spark, path).select("part").distinct().toLocalIterator()} if _finished(spark, path) else set()
    bare = lambda name: re.sub("^file:/+", "file:/", unquote(name))  # noqa: E731  (Spark writes names in two ways)
    done = set(map(bare, done))
    left = sorted(set(map(bare, spark.read.parquet(folder).inputFiles())) - done)
    if left:
        df = spark.read.parquet(*left)
        tallies(df, values, numbers, order, part=F.col("_metadata.file_path")).write.parquet(f"{path}/add-{uuid.uuid4().hex}")
    return len(left)


def _finished(spark: SparkSession, path: str) -> list[str]:
    fs, p = tables._hadoop(spark, path)
    if not fs.exists(p):
        return []
    found = [str(s.getPath()) for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(f for f in found if tables.exists(spark, f"{f}/_SUCCESS"))


def parts(spark: SparkSession, path: str) -> DataFrame:
    """The tallies that ``add_files`` has written."""
    return spark.read.parquet(*_finished(spark, path))
