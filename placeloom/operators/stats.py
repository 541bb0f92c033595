"""Statistics of a run. Each function is one aggregation; ``dataset_statistics`` gathers them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import tables
from . import tallies


def top_values(df: DataFrame, column: str, order: str, n: int = 20) -> DataFrame:
    """The most frequent entries of an array column; ties by first occurrence, then by value."""
    exploded = df.select(F.posexplode(column).alias("_p", "value"), order)
    counted = exploded.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(order, "_p")).alias("_first"))
    return counted.orderBy(F.desc("n"), "_first", "value").limit(n).select("value", "n")


def label_counts(strong: DataFrame, label: str = "label") -> DataFrame:
    return strong.filter(X.has_value(F.col(label))).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def caption_lengths(strong: DataFrame, caption: str = "caption") -> DataFrame:
    """Count, least, mean and greatest number of characters of captions that are not blank."""
    size = F.length(X.strip(F.col(caption)))
    return strong.select(size.alias("size")).filter("size > 0").agg(F.count(F.lit(1)).alias("caption_count"), F.min("size").cast("long").alias("min_chars"), F.avg("size").alias("mean_chars"), F.max("size").cast("long").alias("max_chars"))


def weak_first_categories(weak: DataFrame, businesses: DataFrame, n: int = 20, order: str = "ord") -> DataFrame:
    """The most frequent first category of the weak groups' businesses."""
    firsts = weak.select("business_id").join(businesses.select("business_id", F.get("categories", F.lit(0)).alias("value"), order), "business_id").filter("value is not null")
    return firsts.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first")).orderBy(F.desc("n"), "_first", "value").limit(n).select("value", "n")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """How many different non-empty values; exact."""
    return df.filter(X.has_value(F.col(column))).agg(F.countDistinct(column).alias("n"))


def ratio(part, whole):
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def dataset_statistics(businesses: DataFrame, reviews: DataFrame, photos: DataFrame, images: DataFrame, strong: DataFrame, medium: DataFrame, weak: DataFrame) -> dict:
    """The statistics of a run as one dictionary (small results only reach the driver).

    Each table is read once, by one aggregation over all of them; what it finds is stored.
    """
    kind = businesses.schema["ord"].dataType
    size = F.length(X.strip(F.col("caption")))
    firsts = weak.select("business_id").join(businesses.select("business_id", F.get("categories", F.lit(0)).alias("first"), "ord"), "business_id")
    counted = {
        "businesses": tallies.tallies(businesses, {"city": F.col("city"), "category": F.col("categories")}, order="ord"),
        "reviews": tallies.tallies(reviews, {"business": F.col("business_id")}, order_type=kind),
        "photos": tallies.tallies(photos, order_type=kind),
        "images": tallies.tallies(images, {"business": F.col("business_id")}, order_type=kind),
        "strong": tallies.tallies(strong, {"label": F.col("label")}, {"caption": F.when(size > 0, size)}, order_type=kind),
        "medium": tallies.tallies(medium, order_type=kind),
        "weak": tallies.tallies(weak, order_type=kind),
        "weak_firsts": tallies.tallies(firsts, {"category": F.col("first")}, order="ord"),
    }
    named = [tallies.renamed(df, name) for name, df in counted.items()]
    whole = tables.stored(tallies.summed(reduce(DataFrame.unionByName, named)), "run-statistics")
    found = {r.what: r for r in tallies.figures(whole).collect()}
    rows = lambda name: found[f"{name}.rows"].n if f"{name}.rows" in found else 0
    distinct = lambda what: found[what].distinct_values if what in found else 0
    top = lambda what: [[r.value, r.n] for r in tallies.top(whole, what).collect()]
    captions = found.get("strong.caption")
    n_photos, n_valid = rows("photos"), rows("images")
    return {
        "business_count": rows("businesses"), "review_count": rows("reviews"), "photo_metadata_count": n_photos,
        "city_count": distinct("businesses.city"), "valid_image_count": n_valid, "valid_image_ratio": n_valid / n_photos if n_photos else 0,
        "strong_pairs": rows("strong"), "medium_pairs": rows("medium"), "weak_pairs": rows("weak"),
        "top_categories": top("businesses.category"),
        "photo_label_distribution": {r.value: r.n for r in whole.filter("what = 'strong.label'").orderBy("value").collect()},
        "caption_length_stats": {"caption_count": captions.n if captions else 0, "min_chars": captions and captions.least, "mean_chars": captions and captions["mean"], "max_chars": captions and captions.most},
        "weak_group_top_categories": top("weak_firsts.category"),
        "businesses_with_reviews": distinct("reviews.business"), "businesses_with_valid_images": distinct("images.business"),
    }


def failure_types(cases: DataFrame, column: str = "error_type") -> DataFrame:
    return cases.groupBy(F.coalesce(column, F.lit("unknown")).alias("error_type")).agg(F.count(F.lit(1)).alias("n"))
