"""Pairs of images with captions, with business knowledge, and with reviews.

Order columns (``ord``) stand for the order of the files: the first rows of a key, and the last of
repeated keys, are found by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import attributes as A
from ..functions import text as X

_TRUE = ("true", "True", "1")


def last_of_each(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Of rows with one key the last by order; null keys go. Sums up before the shuffle."""
    rest = [c for c in df.columns if c != key]
    last = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return last.select(key, "_row.*").select(*df.columns)


def first_of_each(df: DataFrame, key: str, n: int, order: str = "ord") -> DataFrame:
    """The first ``n`` rows of each key (a group limit that runs before the shuffle, too)."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def valid_images(image_index: DataFrame, order: str = "ord") -> DataFrame:
    """Readable images, the last row of each photo."""
    ok = F.col("image_valid").cast("string").isin(*_TRUE)
    return last_of_each(image_index.filter(ok & X.has_value(F.col("photo_id").cast("string"))), "photo_id", order)


def strong(photos: DataFrame, images: DataFrame) -> DataFrame:
    """Photos with a caption and a readable image."""
    paths = images.select("photo_id", F.col("image_path").alias("image_path"))
    kept = photos.drop("image_path").filter(X.strip(F.col("caption")) != "").join(paths, "photo_id")
    return kept.select(F.concat(F.lit("strong_"), "photo_id").alias("pair_id"), "photo_id", "business_id", "image_path", X.strip(F.col("caption")).alias("caption"), "label", F.lit("strong").alias("alignment_type"))


def medium(photos: DataFrame, images: DataFrame, businesses: DataFrame) -> DataFrame:
    """Photos with a readable image and a business, described in one line. ``attributes`` and ``hours``
    of the businesses are JSON text."""
    about = businesses.select(
        "business_id",
        A.description(F.col("name"), F.col("categories"), F.col("city"), F.col("state"), F.col("stars"), A.as_map(F.col("attributes")), A.as_map(F.col("hours"))).alias("business_description"),
        A.dimension_labels(A.as_map(F.col("attributes")), A.as_map(F.col("hours"))).alias("attribute_dimension_labels"),
    )
    paired = photos.select("photo_id", "business_id").join(images.select("photo_id", "image_path"), "photo_id").join(about, "business_id")
    return paired.select(F.concat(F.lit("medium_"), "photo_id").alias("pair_id"), "photo_id", "business_id", "image_path", "business_description", "attribute_dimension_labels", F.lit("medium").alias("alignment_type"))


def bounded_reviews(reviews: DataFrame, images: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """The first ``n`` reviews of businesses that have a readable image; three columns are read."""
    having = images.filter(X.has_value(F.col("business_id"))).select("business_id").distinct()
    return first_of_each(reviews.select("review_id", "business_id", "text", order).join(having, "business_id", "left_semi"), "business_id", n, order)


def weak(photos: DataFrame, images: DataFrame, reviews: DataFrame, max_reviews: int = 5, max_images: int = 5, order: str = "ord") -> DataFrame:
    """Per business, parallel arrays of its first readable images and first reviews."""

    def gathered(df: DataFrame, n: int, **columns: str) -> DataFrame:
        rows = first_of_each(df.filter(X.has_value(F.col("business_id"))), "business_id", n, order)
        packed = rows.groupBy("business_id").agg(F.array_sort(F.collect_list(F.struct(order, *dict.fromkeys(columns.values())))).alias("_g"))
        return packed.select("business_id", *[F.col(f"_g.{c}").alias(name) for name, c in columns.items()])

    # photos without a readable image go before the first rows are chosen
    readable = photos.drop("image_path").join(images.select("photo_id", "image_path"), "photo_id")
    pictures = gathered(readable, max_images, photo_ids="photo_id", image_paths="image_path")
    texts = gathered(reviews, max_reviews, review_ids="review_id", review_texts="text")
    return pictures.join(texts, "business_id").select(F.concat(F.lit("weak_"), "business_id").alias("pair_id"), "business_id", "photo_ids", "image_paths", "review_ids", "review_texts", F.lit("weak").alias("alignment_type"))
