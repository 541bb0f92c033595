"""How quality filters interact, from one CUBE over their failure flags.

Flags. Every document is judged by every filter, whatever another filter says of it. Of a document
only its id, its part, a SHA-256 of its text and its flags move on; the text is read once.

CUBE. Documents are counted by part and flags, then the counts are cubed. A row of a grouping set
whose flags are all false counts the documents that pass just those filters: the survivors of a
subset. What a filter removes at a step is the difference of two subsets' survivors, so each step
of each order is a pair of subsets (S, S and one more), and the orders are looked up in the pairs.
With n filters there are 2^n subsets, n 2^(n-1) pairs and n! orders for each part.

A document is a repeat (E) if a smaller ``doc_id`` in the whole table has an identical text. The
smallest id of a text is a minimum, taken before the shuffle; ids and texts meet again on both the
text's hash and the id, so that copies of one text spread over the tasks.

Edge cases: a null text is empty (and copies of it repeats); a null source is the part ''; a null
``doc_id`` is no repeat and makes none, and has no labels; repeated rows share their id and are
no repeats of one another; of several labels of one id any one counts; null labels do not count;
other columns are ignored; an empty table gives no parts and an empty result.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, stored, table

FEW_WORDS, FEW_DISTINCT, MANY_CAPITALS, SYMBOLS = 200, 50, 2, "[#$%&*|]"
NAMES = "ABCDE"


def word_list(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " +"), "")


def flagged(docs: DataFrame) -> DataFrame:
    """doc_id, part, hash and the flags A to D of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = own.withColumn("words", word_list(F.col("text")))
    n, size = F.size("words"), F.length("text")
    return words.select(
        "doc_id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("hash"),
        (n < FEW_WORDS).alias("A"),
        (F.size(F.array_distinct("words")).cast("long") * 100 < n.cast("long") * FEW_DISTINCT).alias("B"),
        ((size - F.length(F.translate("text", UPPER, ""))).cast("long") * 100 > size.cast("long") * MANY_CAPITALS).alias("C"),
        F.col("text").rlike(SYMBOLS).alias("D"),
    )


def repeats(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, hash and more) with E: whether a smaller doc_id has the same hash."""
    first = rows.groupBy("hash").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = rows.filter("doc_id is not null").join(first.filter("doc_id is not null"), ["hash", "doc_id"], "left")
    return known.withColumn("E", F.col("first").isNull()).drop("first")


def survivors(counts: DataFrame, flags: str | list[str], measures: list[str]) -> DataFrame:
    """part, subset and measures: what passes each subset of the filters. Bit i of ``subset`` is flag i.

    ``counts`` has part (not null), the flags (not null) and the measures. Every part has every subset.
    """
    flags = list(flags)
    cube = counts.cube("part", *flags).agg(*[F.sum(m).alias(m) for m in measures])
    # neither part nor flags are null, so a null says that the grouping set leaves the column out
    passed = cube.filter(F.col("part").isNotNull())
    subset = F.lit(0)
    for i, f in enumerate(flags):
        passed = passed.filter(F.coalesce(~F.col(f), F.lit(True)))
        subset = subset + F.when(F.col(f).isNotNull(), 1 << i).otherwise(0)
    passed = passed.select("part", subset.alias("subset"), *measures)
    every = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(flags)) - 1))).alias("subset"))
    return every.join(passed, ["part", "subset"], "left").select("part", "subset", *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in measures])


def steps(left: DataFrame, flags: str | list[str]) -> DataFrame:
    """One row for each part, order of the filters and step. ``left`` is ``survivors`` with the measures n, good, toxic."""
    flags = list(flags)
    n, whole = len(flags), (1 << len(flags)) - 1
    outside = F.array_compact(F.array(*[F.when(F.col("subset").bitwiseAND(F.lit(1 << i)) == 0, i) for i in range(n)]))
    before = left.select("*", F.explode(outside).alias("filter"))
    before = before.withColumn("then", F.col("subset") + F.element_at(F.array(*[F.lit(1 << i) for i in range(n)]), F.col("filter") + 1))
    after = left.select("part", F.col("subset").alias("then"), *[F.col(m).alias(f"{m}_after") for m in ("n", "good", "toxic")])
    pairs = before.join(after, ["part", "then"]).select(
        "part", "subset", "filter", F.col("n_after").alias("kept"), *[(F.col(m) - F.col(f"{m}_after")).alias(name) for m, name in (("n", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))]
    )
    # orders that apply just the filters of a subset before this one
    chosen = F.bit_count("subset")
    times = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), (chosen + 1).cast("int"))
    rest = F.element_at(F.array(*[F.lit(whole - (1 << i)) for i in range(n)]), F.col("filter") + 1)
    totals = pairs.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("subset") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.col("subset") == rest, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * times).cast("long").alias("shapley"),
    )
    orders = [("".join(flags[i] for i in p), k + 1, sum(1 << i for i in p[:k]), p[k]) for p in permutations(range(n)) for k in range(n)]
    at = left.sparkSession.createDataFrame(orders, "filter_order string, step int, subset int, filter int")
    return (
        pairs.join(totals, ["part", "filter"])
        .join(F.broadcast(at), ["subset", "filter"])  # n! n rows, whatever the input
        .select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters of this module over ``docs``, for each part: see ``steps``."""
    rows = stored(flagged(docs).groupBy("doc_id", "part", "hash", *NAMES[:4]).agg(F.count("*").alias("rows")), "audit-rows")
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("int").alias(c)
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(is_one("quality"), is_one("toxic"))
    zero = F.lit(0)
    known = repeats(rows).join(marks, "doc_id", "left").select("part", *NAMES, "rows", F.coalesce("quality", zero).alias("quality"), F.coalesce("toxic", zero).alias("toxic"))
    unnamed = rows.filter("doc_id is null").select("part", *NAMES[:4], F.lit(False).alias("E"), "rows", zero.alias("quality"), zero.alias("toxic"))
    counts = known.unionByName(unnamed).groupBy("part", *NAMES).agg(F.sum("rows").alias("n"), F.sum(F.col("rows") * F.col("quality")).alias("good"), F.sum(F.col("rows") * F.col("toxic")).alias("toxic"))
    left = stored(survivors(stored(counts, "audit-counts"), NAMES, ["n", "good", "toxic"]), "audit-survivors")
    return steps(left, NAMES)


def op13_filter_interactions(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, len(words) < 200 AS A, 100 * len(list_distinct(words)) < 50 * len(words) AS B,
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS C,
    regexp_matches(text, '[#$%&*|]') AS D, coalesce(doc_id > first_id, false) AS E, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic
  FROM w LEFT JOIN marks m USING (doc_id)
), coded AS (
  SELECT part, CAST(A AS INT) + 2 * CAST(B AS INT) + 4 * CAST(C AS INT) + 8 * CAST(D AS INT) + 16 * CAST(E AS INT) AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)
), orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), grid AS (
  SELECT filter_order, unnest(range(1, 6)) AS step, bits FROM orders
), places AS (
  SELECT filter_order, step, bits[step] AS own, CAST(coalesce(list_sum(bits[1 : step - 1]), 0) AS INT) AS before FROM grid
), counted AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN fails & (before | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails & before = 0 AND fails & own > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & before > 0 AND fails & own > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & before = 0 AND fails & own > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails & before = 0 AND fails & own > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM coded, places GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""
