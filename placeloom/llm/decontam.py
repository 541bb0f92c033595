"""Benchmark decontamination with a distributed positional inverted index.

All steps are DataFrame operations.

1. The words of the test items are looked up in all training documents, and each term's
   occurrences are counted (partial counts before the shuffle).
2. Every window of ``n`` consecutive item words (the whole item, if it is shorter) picks its
   ``anchors`` rarest terms. A window with a term that occurs nowhere needs no further work.
3. The postings (term, document, position) of the picked terms are stored: that is the index.
4. Each posting, moved by its term's offset in an item, names a diagonal of that item in a
   document. Intersecting the offset-adjusted lists keeps the diagonals on which at least as many
   picked terms meet as a window picks.
5. Exact check: along each diagonal the words are compared, and the windows that agree in every
   word are hits.
6. Proximity. A posting of a picked term is a near match if another picked term of the item stands
   in the document within ``slop`` words of where the item would have it beside the first. All
   pairs of postings within the range count (two window counts over the sorted diagonals), not
   only neighbouring ones.

Terms are hashed after full lower-casing, which merges at least the words that are equal after
lower-casing A-Z; the exact check separates the rest. Test items are broadcast only while their
count is below ``BROADCAST_ROWS``; beyond, the same joins shuffle.

Edge cases: a null text has no words, and neither has one without word characters; items without
words never occur; equal items share one index entry and are each reported; rows with equal or
null ``doc_id`` are each checked on their own text (rows are told apart by id and hash of the text,
so rows without id never meet in one group unless their texts are equal); a null ``item_id`` is listed as ``null``;
empty tables and extra columns are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import lower_ascii, stored, table

#: what is no word character, before and after lower-casing
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
N, ANCHORS, SLOP, BROADCAST_ROWS, BROADCAST_WORDS = 10, 2, 3, 500_000, 2_000_000
_NO_ID = -(1 << 63)


def words_of(text: Column) -> Column:
    """The words as written, in order."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS), "")


def term(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def _sized(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def _key() -> tuple[Column, Column]:
    """doc and same: equal for rows of equal id and text only."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("same")


def distinct_items(benchmark: DataFrame) -> DataFrame:
    """item (a hash), words, ids: one row for each distinct sequence of words."""
    words = words_of(lower_ascii(F.col("text").cast("string")))
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), words.alias("words")).filter(F.size("words") > 0)
    return named.groupBy("words").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.xxhash64("words").alias("item"), "words", "ids")


def _positions(docs: DataFrame) -> DataFrame:
    words = docs.select(*_key(), words_of(F.col("text").cast("string")).alias("ws"))
    return words.select("doc", "same", F.posexplode("ws").alias("pos", "word")).select("doc", "same", "pos", term(F.col("word")).alias("term"))


def term_counts(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """(term, n): occurrences in all documents of the terms given."""
    return _positions(docs).join(_sized(terms, n_terms), "term").groupBy("term").agg(F.count("*").alias("n"))


def picked_terms(items: DataFrame, counts: DataFrame, n: int = N, anchors: int = ANCHORS) -> DataFrame:
    """(term, item, at, need): the rarest terms of each window that can occur at all."""
    length = F.least(F.size("words"), F.lit(n))
    windows = items.select("item", "words", length.alias("len"), F.explode(F.sequence(F.lit(0), F.size("words") - length)).alias("w"))
    slots = windows.select("item", "w", "len", F.posexplode(F.slice("words", F.col("w") + 1, F.col("len"))).alias("off", "word"))
    known = slots.withColumn("term", term(F.col("word"))).join(counts, "term", "left")
    one = Window.partitionBy("item", "w")
    ranked = known.withColumns({"r": F.row_number().over(one.orderBy(F.col("n").asc_nulls_first(), "off")), "absent": F.max(F.col("n").isNull().cast("int")).over(one)})
    return (
        ranked.filter((F.col("absent") == 0) & (F.col("r") <= anchors))
        .select("term", "item", (F.col("w") + F.col("off")).alias("at"), F.least(F.col("len"), F.lit(anchors)).alias("need"))
        .groupBy("term", "item", "at").agg(F.min("need").alias("need"))
    )


def build_index(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """The stored postings (term, doc, same, pos) of the terms given."""
    return stored(_positions(docs).join(_sized(terms, n_terms), "term").select("term", "doc", "same", "pos"), "postings")


def adjusted(index: DataFrame, picked: DataFrame, n_picked: int) -> DataFrame:
    """(doc, same, item, diagonal, at, need): postings moved by their term's place in an item."""
    return index.join(_sized(picked, n_picked), "term").select("doc", "same", "item", (F.col("pos") - F.col("at")).alias("diagonal"), "at", "need")


def diagonals(moved: DataFrame) -> DataFrame:
    """(doc, same, item, diagonal) on which enough of the offset-adjusted lists meet."""
    met = moved.groupBy("doc", "same", "item", "diagonal").agg(F.count("*").alias("met"), F.min("need").alias("need"))
    return met.filter("met >= need").select("doc", "same", "item", "diagonal")


def near(moved: DataFrame, slop: int = SLOP) -> DataFrame:
    """(doc, same, item, pos, partners): postings of ``moved`` that have postings of other picked terms
    of the item within ``slop`` words of their places, and how many."""
    around = lambda *by: Window.partitionBy("doc", "same", "item", *by).orderBy("diagonal").rangeBetween(-slop, slop)
    counted = moved.withColumn("partners", F.count("*").over(around()) - F.count("*").over(around("at")))
    return counted.filter("partners > 0").select("doc", "same", "item", (F.col("diagonal") + F.col("at")).alias("pos"), "partners")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = SLOP, n: int = N, anchors: int = ANCHORS) -> DataFrame:
    """(doc_id, item_id, pos, partners): where a picked term of an item is a near match."""
    items, picked, n_picked, index = _prepared(docs, benchmark, n, anchors)
    found = near(adjusted(index, picked, n_picked), slop).groupBy("doc", "item", "pos").agg(F.max("partners").alias("partners"))
    return found.join(items, "item").select(F.when(F.col("doc") != _NO_ID, F.col("doc")).alias("doc_id"), F.explode("ids").alias("item_id"), "pos", "partners")


def _prepared(docs: DataFrame, benchmark: DataFrame, n: int, anchors: int):
    items = stored(distinct_items(benchmark), "items")
    terms = stored(items.select(F.explode("words").alias("word")).select(term(F.col("word")).alias("term")).distinct(), "item-terms")
    counts = term_counts(docs, terms, terms.count())
    picked = stored(picked_terms(items, counts, n, anchors), "picked")
    n_picked = picked.count()
    index = build_index(docs, picked.select("term").distinct(), n_picked)
    return items, picked, n_picked, index


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, anchors: int = ANCHORS, whole: bool = False, slop: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (ids), items_sha256, contaminated;
    if ``whole``, also the document's own row as the struct ``row``; with a ``slop`` also n_near, the
    number of its words that are near matches of some item."""
    items, picked, n_picked, index = _prepared(docs, benchmark, n, anchors)
    moved = adjusted(index, picked, n_picked)
    known = diagonals(moved).join(items, "item").groupBy("doc", "same").agg(F.collect_list(F.struct("diagonal", "words", "ids")).alias("hits"))
    known = stored(known, "candidates")
    size = known.agg(F.coalesce(F.sum(F.expr("aggregate(hits, 0L, (s, h) -> s + size(h.words) + 4)")), F.lit(0))).first()[0]
    own = ["row"] if whole else []
    rows = docs.withColumn("row", F.struct(*docs.columns)) if whole else docs
    joined = rows.select("doc_id", F.col("text").cast("string").alias("text"), *_key(), *own).join(_sized(known, size, BROADCAST_WORDS), ["doc", "same"], "left")
    if slop is not None:
        close = stored(near(moved, slop).groupBy("doc", "same").agg(F.countDistinct("pos").alias("n_near")), "near-matches")
        joined = joined.join(_sized(close, close.count()), ["doc", "same"], "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("long"))
        own.append("n_near")
    worded = joined.select("doc_id", *own, "hits", words_of(F.col("text")).alias("ws"))
    lowered = F.when(F.col("hits").isNotNull(), F.transform("ws", lower_ascii))
    checked = worded.select("doc_id", *own, F.size("ws").cast("long").alias("n_words"), "hits", lowered.alias("low"))

    def matched(h: Column) -> Column:
        """h with the places of the document's words that its windows hit."""
        length = F.least(F.size(h["words"]), F.lit(n))
        first, last = F.greatest(F.lit(0), -h["diagonal"]), F.size(h["words"]) - length
        starts = F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))
        same = F.filter(starts, lambda o: F.slice(F.col("low"), h["diagonal"] + o + 1, length) == F.slice(h["words"], o + 1, length))
        return F.struct(F.flatten(F.transform(same, lambda o: F.sequence(h["diagonal"] + o, h["diagonal"] + o + length - 1))).alias("at"), h["ids"].alias("ids"))

    exact = checked.select("doc_id", *own, "n_words", F.filter(F.transform("hits", matched), lambda h: F.size(h["at"]) > 0).alias("exact"))
    at = F.array_distinct(F.flatten(F.transform("exact", lambda h: h["at"])))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("exact", lambda h: h["ids"]))))
    out = exact.select("doc_id", *own, "n_words", F.coalesce(F.size(at), F.lit(0)).alias("hit"), F.coalesce(ids, F.array().cast("array<string>")).alias("items"))
    out = out.withColumn("hit", F.greatest("hit", F.lit(0)).cast("long"))
    return out.select("doc_id", *own, "n_words", F.col("hit").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("hit") > 0).alias("contaminated"))


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=SLOP).drop("items")


OP1_SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents
), items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[o + 1 : o + least(10, len(ws))], ' ') AS phrase
  FROM (SELECT item_id, ws, unnest(range(0, len(ws) - least(10, len(ws)) + 1)) AS o FROM items WHERE len(ws) > 0)
), grams AS (
  SELECT doc_id, n, o, array_to_string(ws[o + 1 : o + n], ' ') AS phrase
  FROM (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS o FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n)
), hits AS (
  SELECT g.doc_id, g.o, g.n, w.item_id FROM grams g JOIN windows w ON g.n = w.n AND g.phrase = w.phrase
), tokens AS (
  SELECT doc_id, lower(unnest(ws)) AS term, generate_subscripts(ws, 1) - 1 AS pos FROM docs
), sequences AS (
  SELECT ws, row_number() OVER () AS item FROM (SELECT DISTINCT ws FROM items WHERE len(ws) > 0)
), terms AS (
  SELECT DISTINCT lower(unnest(ws)) AS term FROM sequences
), counts AS (
  SELECT term, count(*) AS n FROM tokens JOIN terms USING (term) GROUP BY term
), slots AS (
  SELECT item, w, unnest(range(0, least(10, len(ws)))) AS off, lower(unnest(ws[w + 1 : w + least(10, len(ws))])) AS term
  FROM (SELECT item, ws, unnest(range(0, len(ws) - least(10, len(ws)) + 1)) AS w FROM sequences)
), ranked AS (
  SELECT item, w, off, term, row_number() OVER (PARTITION BY item, w ORDER BY n ASC NULLS FIRST, off) AS r, count(*) OVER (PARTITION BY item, w) - count(n) OVER (PARTITION BY item, w) AS absent
  FROM slots LEFT JOIN counts USING (term)
), picked AS (
  SELECT DISTINCT term, item, w + off AS spot FROM ranked WHERE absent = 0 AND r <= 2
), moved AS (
  SELECT doc_id, item, spot, pos, pos - spot AS diagonal FROM tokens JOIN picked USING (term)
), partnered AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, item ORDER BY diagonal RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) - count(*) OVER (PARTITION BY doc_id, item, spot ORDER BY diagonal RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS partners FROM moved
), close AS (
  SELECT doc_id, count(DISTINCT pos) AS n_near FROM partnered WHERE partners > 0 GROUP BY doc_id
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(o, o + n)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated, CAST(coalesce(c.n_near, 0) AS BIGINT) AS n_near
FROM docs d LEFT JOIN places p USING (doc_id) LEFT JOIN named m USING (doc_id) LEFT JOIN close c USING (doc_id)
"""


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a passage of the benchmark go.

    Each row stays or goes by its own text, whatever its ``doc_id``.
    """
    return contamination(docs, table(spark, sf_dir, "benchmark"), whole=True).filter(~F.col("contaminated")).select("row.*")
