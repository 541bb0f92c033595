"""A catalog of places from businesses, with its reviews and photos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .align import first_of_each
from .parse import first_rows

#: Categories that make a business relevant to travellers (fixed values).
RELEVANT = ("restaurants", "food", "cafes", "coffee & tea", "hotels", "hotel", "travel services", "active life", "arts & entertainment", "museums", "landmarks & historical buildings", "shopping", "nightlife", "parks", "local flavor")
#: Main kind of a place, by the first line that one of its categories is in (fixed values).
KINDS = (
    ("Cafe", ("cafes", "coffee & tea")),
    ("Restaurant", ("restaurants", "food")),
    ("Hotel", ("hotels", "hotel")),
    ("Attraction", ("arts & entertainment", "museums", "landmarks & historical buildings", "parks")),
    ("Shopping", ("shopping",)),
    ("Nightlife", ("nightlife",)),
)


def _any_of(cats: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(cats, F.array(*map(F.lit, names)))


def is_relevant(cats: Column) -> Column:
    return F.coalesce(_any_of(cats, RELEVANT), F.lit(False))


def main_kind(cats: Column) -> Column:
    out = F.lit("POI")
    for kind, names in reversed(KINDS):
        out = F.when(_any_of(cats, names), kind).otherwise(out)
    return out


def is_open(flag: Column, include_closed: bool = False) -> Column:
    """Only 0 is closed; an unknown state stays."""
    return F.lit(True) if include_closed else ~flag.eqNullSafe(F.lit(0))


def selected(businesses: DataFrame, most: int | None = None, include_closed: bool = False) -> DataFrame:
    """Relevant, open businesses; the first ``most`` of them."""
    return first_rows(businesses.filter(is_open(F.col("is_open"), include_closed) & is_relevant(F.col("categories"))), most)


def places(businesses: DataFrame, source: str = "open_dataset") -> DataFrame:
    """Catalog rows. ``attributes`` stays JSON text."""
    tags = F.array_sort(F.array_distinct("categories"))
    return businesses.select(
        F.concat(F.lit("poi_"), "business_id").alias("poi_id"), F.lit(source).alias("source"), "business_id", "name", main_kind(F.col("categories")).alias("category"), "city", "state", "latitude", "longitude",
        F.col("stars").alias("rating"), "review_count", tags.alias("tags"), "attributes", X.joined(" ", F.col("name"), main_kind(F.col("categories")), F.col("city"), F.col("state")).alias("description"),
    )


def place_reviews(reviews: DataFrame, catalog: DataFrame, n: int = 5, source: str = "open_dataset") -> DataFrame:
    """The first ``n`` reviews of each place."""
    kept = first_of_each(reviews.join(catalog.select("business_id"), "business_id", "left_semi"), "business_id", n)
    return kept.join(catalog.select("business_id", "poi_id"), "business_id").select("review_id", "poi_id", "business_id", F.col("stars").alias("rating"), F.coalesce("text", F.lit("")).alias("text"), "date", F.lit(source).alias("source"))


def place_photos(photos: DataFrame, catalog: DataFrame, root: str = "photos", source: str = "open_dataset") -> DataFrame:
    own = photos.filter(X.has_value(F.col("photo_id"))).join(catalog.select("business_id", "poi_id"), "business_id")
    return own.select(F.concat(F.lit("photo_"), "photo_id").alias("item_id"), "poi_id", "business_id", "photo_id", F.concat(F.lit(root + "/"), "photo_id", F.lit(".jpg")).alias("image_path"), F.coalesce("caption", F.lit("")).alias("caption"), F.coalesce("label", F.lit("")).alias("label"), F.lit(source).alias("source"))


def manifest(catalog: DataFrame, reviews: DataFrame, photos: DataFrame) -> dict:
    return {"business_count": catalog.count(), "review_count": reviews.count(), "multimodal_item_count": photos.count()}
