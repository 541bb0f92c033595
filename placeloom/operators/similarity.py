"""Candidate pairs of weak groups, their scores, and what passes the threshold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X

THRESHOLD = 0.25


def candidates(weak: DataFrame) -> DataFrame:
    """Each image of a group with each of its reviews; the groups' arrays are bounded upstream."""
    images = weak.select("business_id", "review_ids", "review_texts", F.inline(F.arrays_zip("photo_ids", "image_paths")).alias("photo_id", "image_path"))
    images = images.filter(X.has_value(F.col("photo_id")) & X.has_value(F.col("image_path")))
    pairs = images.select("business_id", "photo_id", "image_path", F.inline(F.arrays_zip("review_ids", "review_texts")).alias("review_id", "review_text"))
    pairs = pairs.withColumn("review_text", X.strip(F.col("review_text")))
    return pairs.filter(X.has_value(F.col("review_id")) & X.has_value(F.col("review_text")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if either is missing or has length 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def scored(pairs: DataFrame, image_vectors: DataFrame, text_vectors: DataFrame) -> DataFrame:
    """``pairs`` with clip_similarity, from vectors by image_path and by review_text; null if one is missing."""
    images = image_vectors.select("image_path", F.col("vector").alias("_i"))
    texts = text_vectors.select("review_text", F.col("vector").alias("_t"))
    return pairs.join(images, "image_path", "left").join(texts, "review_text", "left").withColumn("clip_similarity", cosine(F.col("_i"), F.col("_t"))).drop("_i", "_t")


def scored_by(pairs: DataFrame, scorer: Callable[[Column, Column], Column]) -> DataFrame:
    """The same with any expression or pandas UDF of path and text; each distinct pair is scored once."""
    once = pairs.select("image_path", "review_text").distinct().withColumn("clip_similarity", scorer(F.col("image_path"), F.col("review_text")).cast("double"))
    return pairs.join(once, ["image_path", "review_text"])


def retained(scores: DataFrame, threshold: float = THRESHOLD, model: str = "cosine") -> DataFrame:
    """Pairs at or above the threshold (NaN counts as above); unscored pairs are left out."""
    return scores.filter(F.col("clip_similarity") >= threshold).select("business_id", "photo_id", "image_path", "review_id", "review_text", "clip_similarity", F.lit(model).alias("clip_model"), F.lit("weak_denoised").alias("alignment_type"))


def summary(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row: pairs in, scored, skipped and retained, their range, and the share retained."""
    return scores.agg(*_measures(threshold)).withColumn("retention_rate", retention_rate(F.col("retained_pairs"), F.col("input_pairs")))


def _measures(threshold: float) -> list[Column]:
    s = F.col("clip_similarity")
    return [F.count(F.lit(1)).alias("input_pairs"), F.count(s).alias("scored_pairs"), F.count_if(s.isNull()).alias("skipped_candidates"), F.count_if(s >= threshold).alias("retained_pairs"), F.min(s).alias("min"), F.avg(s).alias("mean"), F.max(s).alias("max")]


def observed(scores: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, Observation]:
    """The same measures, gathered while the scores are used: each pair is scored once for both."""
    seen = Observation("similarity")
    return scores.observe(seen, *_measures(threshold)), seen


def skipped_summary(weak: DataFrame, reason: str, threshold: float = THRESHOLD, model: str = "cosine") -> DataFrame:
    """The summary of a run that could not score."""
    n = candidates(weak).agg(F.count(F.lit(1)).alias("input_pairs"))
    groups = weak.agg(F.count(F.lit(1)).alias("input_groups"))
    zero = lambda name: F.lit(0).cast("long").alias(name)
    return groups.join(n).select(F.lit("skipped").alias("status"), F.lit(reason).alias("reason"), "input_groups", "input_pairs", zero("scored_pairs"), zero("skipped_candidates"), zero("retained_pairs"), F.lit(threshold).alias("threshold"), F.lit(model).alias("model_id"), F.lit("not_started").alias("device"))


def retention_rate(kept: Column, given: Column) -> Column:
    """Per cent with two decimals, rounded by the number's binary value and ties to even, as C and Python do; ``format_string`` rounds its decimal text up."""
    rate = F.call_function("format_number", 100.0 * kept / given, F.lit("0.00"))
    return F.when(kept.isNull() | given.isNull(), "TODO").when(given <= 0, "0.00%").otherwise(F.concat(rate, F.lit("%")))


def batch_number(df: DataFrame, size: int, order: str, ranges: int = 256) -> DataFrame:
    """``df`` with the number of its fixed-size batch, in order over the whole table.

    Rows are numbered within ranges of the order, whose limits are quantiles; each range's first
    number follows from the counts of those before it. Ties are in one range, in any order.
    """
    if size < 1:
        raise ValueError("a batch has at least one row")
    cuts = df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10_000).alias("c")).first().c or []
    at = F.lit(0)
    for cut in sorted(set(cuts)):
        at = at + (F.col(order) > F.lit(cut)).cast("int")
    ranged = df.withColumn("_range", F.coalesce(at, F.lit(-1)))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    firsts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    numbered = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_range").orderBy(order)))
    return numbered.join(F.broadcast(firsts), "_range").withColumn("batch", F.floor((F.col("_first") + F.col("_i") - 1) / size)).drop("_range", "_i", "_first")
