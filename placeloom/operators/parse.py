"""Records to tables: businesses, reviews and photos, with counts of what was rejected.

Inputs are DataFrames with an order column where order matters (see ``sources.tables.ordered``).
Ids are text; a null or empty id is rejected and never joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import attributes as A
from ..functions import text as X

REASONS = ("missing_identifier", "empty", "symbol_only", "too_short")


def _col(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column, or nulls where the records have none."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)


def with_reason(reviews: DataFrame, min_length: int = 20, reject_symbols: bool = True) -> DataFrame:
    """``reviews`` with stripped text and ``filter_reason``: the first rule it breaks, or null."""
    body = F.coalesce(X.strip(F.col("text").cast("string")), F.lit(""))
    named = X.has_value(_col(reviews, "review_id")) & X.has_value(_col(reviews, "business_id"))
    reason = F.when(~named, REASONS[0]).when(F.col("text") == "", REASONS[1])
    if reject_symbols:
        reason = reason.when(X.symbols_only(F.col("text")), REASONS[2])
    reason = reason.when(F.length("text") < min_length, REASONS[3])
    return reviews.withColumn("text", body).withColumn("filter_reason", reason)


def valid_reviews(reasoned: DataFrame) -> DataFrame:
    kinds = {"review_id": "string", "business_id": "string", "user_id": "string", "stars": "double", "useful": "long", "funny": "long", "cool": "long", "text": "string", "date": "string"}
    order = [c for c in reasoned.columns if c == "ord"]
    return reasoned.filter("filter_reason is null").select(*[_col(reasoned, n, k) for n, k in kinds.items()], *order)


def review_counts(reasoned: DataFrame) -> DataFrame:
    """One row: input, valid and each reason."""
    return reasoned.agg(*_review_metrics())


def _review_metrics() -> list[Column]:
    r = F.col("filter_reason")
    return [F.count(F.lit(1)).alias("input_reviews"), F.count_if(r.isNull()).alias("valid_reviews"), *[F.count_if(r == x).alias(f"filtered_{x}") for x in REASONS]]


def observed_reviews(reasoned: DataFrame, name: str = "review_filters") -> tuple[DataFrame, Observation]:
    """The same counts, gathered while the valid rows are written: one scan for both."""
    seen = Observation(name)
    return reasoned.observe(seen, *_review_metrics()), seen


def review_stats(reviews: DataFrame) -> DataFrame:
    """Per business: number of valid reviews, and the mean of what stars there are."""
    return reviews.groupBy("business_id").agg(F.count(F.lit(1)).alias("valid_review_count"), F.avg("stars").alias("average_review_stars"))


def businesses(records: DataFrame) -> DataFrame:
    """Records (attributes and hours as maps or JSON text) to the fixed business schema.

    ``attr_flat`` holds the selected attributes in one map: no columns that depend on the data.
    """
    kinds = dict(records.dtypes)

    def mapped(name: str) -> Column:
        kind = kinds.get(name, "string")
        return F.col(name).cast(A.MAP) if kind.startswith("map") else A.as_map(F.to_json(name) if kind.startswith("struct") else _col(records, name))

    cats = X.category_list(F.col("categories")) if kinds.get("categories", "").startswith("array") else X.categories(_col(records, "categories"))
    plain = {"business_id": "string", "name": "string", "address": "string", "city": "string", "state": "string", "postal_code": "string", "latitude": "double", "longitude": "double", "stars": "double", "review_count": "long", "is_open": "long"}
    order = [c for c in records.columns if c == "ord"]
    return records.select(
        *[_col(records, n, k) for n, k in plain.items()], cats.alias("categories"), A.sorted_json(mapped("attributes")).alias("attributes"), A.sorted_json(mapped("hours")).alias("hours"), A.flattened(mapped("attributes")).alias("attr_flat"), *order
    )


def identified(table: DataFrame, key: str) -> DataFrame:
    """Rows whose id is neither null nor empty."""
    return table.filter(X.has_value(F.col(key)))


def photos(records: DataFrame, image_root: str) -> DataFrame:
    """Photo records with captions and labels that are never null, and the image's path."""
    path = F.concat(F.lit(image_root.replace("\\", "/").rstrip("/") + "/"), F.col("photo_id").cast("string"), F.lit(".jpg"))
    order = [c for c in records.columns if c == "ord"]
    return records.select(_col(records, "photo_id"), _col(records, "business_id"), F.coalesce(_col(records, "caption"), F.lit("")).alias("caption"), F.coalesce(_col(records, "label"), F.lit("")).alias("label"), path.alias("image_path"), *order).filter(X.has_value(F.col("photo_id")))


def parse_counts(records: DataFrame, key: str, noun: str) -> DataFrame:
    """One row: input, parsed and rejected records."""
    ok = F.coalesce(X.has_value(F.col(key).cast("string")), F.lit(False))
    return records.agg(F.count(F.lit(1)).alias(f"input_{noun}"), F.count_if(ok).alias(f"parsed_{noun}"), F.count_if(~ok).alias(f"missing_{key}"))


def first_rows(df: DataFrame, n: int | None, order: str = "ord") -> DataFrame:
    """The first ``n`` rows by order; all if ``n`` is None, none if it is 0."""
    return df if n is None else df.orderBy(order).limit(n)
