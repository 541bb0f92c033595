"""The place pipeline: parse, validate images, align, denoise, report, check."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, catalog, contract, parse, similarity, stats
from ..sources import images, settings, tables

BUSINESS = "business_id string, name string, address string, city string, state string, postal_code string, latitude double, longitude double, stars double, review_count long, is_open long, categories string, attributes map<string,string>, hours map<string,string>"
REVIEW = "review_id string, business_id string, user_id string, stars double, useful long, funny long, cool long, text string, date string"
PHOTO = "photo_id string, business_id string, caption string, label string"


def _records(spark: SparkSession, path: str, schema: str, most: int | None):
    """The records of a file, and a function for its line counts. Without a limit the scan that writes the table counts the lines."""
    lines = tables.json_lines(spark, path)
    if most is not None or not tables.exists(spark, path):
        return parse.first_rows(tables.json_records(lines, schema), most), lambda: tables.line_counts(lines).first().asDict()
    counted, seen = tables.counted_lines(lines)
    return tables.json_records(counted, schema), lambda: dict(seen.get)


def run_parse(spark: SparkSession, config: dict) -> dict:
    """Raw JSON lines to the interim tables; returns and writes the validation summary."""
    paths, fmt, limits = config["paths"], config["output"]["format"], config["processing_limits"]
    settings.make_folders(config)
    out = lambda df, name: tables.write_table(df.drop("ord"), f"{paths['interim_dir']}/{name}.{fmt}", fmt)
    raw_b, lines_b = _records(spark, paths["business_json"], BUSINESS, limits["max_businesses"])
    raw_r, lines_r = _records(spark, paths["review_json"], REVIEW, limits["max_reviews"])
    raw_p, lines_p = _records(spark, paths["photo_json"], PHOTO, limits["max_photos"])
    outputs = [out(parse.identified(parse.businesses(raw_b), "business_id"), "business")]
    reasoned, seen = parse.observed_reviews(parse.with_reason(raw_r, config["review_filters"]["min_text_length"], config["review_filters"]["reject_symbol_only"]))
    outputs.append(out(parse.valid_reviews(reasoned), "reviews"))
    rejects = seen.get
    valid = tables.read_table(spark, f"{paths['interim_dir']}/reviews.{fmt}", REVIEW)
    outputs.append(out(parse.review_stats(valid), "review_business_stats"))
    photos = parse.photos(raw_p, paths["image_root"])
    outputs += [out(photos, "photos"), out(images.image_index(photos, paths["image_root"]), "photo_image_index")]
    index = tables.read_table(spark, f"{paths['interim_dir']}/photo_image_index.{fmt}", tables.IMAGE_INDEX)
    summary = {"lines": {"business": lines_b(), "reviews": lines_r(), "photos": lines_p()}, "businesses": parse.parse_counts(raw_b, "business_id", "businesses").first().asDict(), "review_filters": dict(rejects), "photos": parse.parse_counts(raw_p, "photo_id", "photos").first().asDict(), "image_validation": images.image_counts(index).first().asDict(), "outputs": outputs}
    for layer in ("interim_dir", "validation_dir"):
        tables.write_json(f"{paths[layer]}/validation_summary.json", summary)
    return summary


def _interim(spark: SparkSession, config: dict, name: str) -> DataFrame:
    return tables.read_table(spark, f"{config['paths']['interim_dir']}/{name}.{config['output']['format']}", order=True)


def run_alignment(spark: SparkSession, config: dict) -> dict:
    """Interim tables to the three kinds of pairs and the statistics, in the run's format."""
    paths, fmt, caps = config["paths"], config["output"]["format"], config["weak_alignment"]
    business, reviews, photos, index = (_interim(spark, config, n) for n in ("business", "reviews", "photos", "photo_image_index"))
    ok = align.valid_images(index)
    businesses = align.last_of_each(business, "business_id")
    few = align.bounded_reviews(reviews, ok, caps["max_reviews_per_business"])
    made = {"strong_image_caption_pairs": align.strong(photos, ok), "image_business_attribute_pairs": align.medium(photos, ok, businesses), "business_level_weak_pairs": align.weak(photos, ok, few, caps["max_reviews_per_business"], caps["max_images_per_business"])}
    for name, df in made.items():
        tables.write_table(df, f"{paths['processed_dir']}/{name}.{fmt}", fmt)
    strong, medium, weak = (tables.read_table(spark, f"{paths['processed_dir']}/{n}.{fmt}") for n in made)
    found = stats.dataset_statistics(business, reviews, photos, ok, strong, medium, weak)
    tables.write_json(f"{paths['processed_dir']}/dataset_statistics.json", found)
    return found


def run_denoising(spark: SparkSession, config: dict, scorer=None, model: str = "injected") -> dict:
    """Score and filter the weak groups' candidates. ``scorer`` maps (path, text) columns to a score."""
    paths, fmt, own = config["paths"], config["output"]["format"], config["clip_denoising"]
    weak = tables.read_table(spark, f"{paths['processed_dir']}/business_level_weak_pairs.{fmt}")
    target = f"{paths['processed_dir']}/{own.get('output_filename', 'weak_pairs_denoised')}.{fmt}"
    threshold = float(own.get("threshold", similarity.THRESHOLD))
    if not own.get("enabled") or scorer is None:
        why = "scoring is switched off" if not own.get("enabled") else "no scorer is available"
        result = similarity.skipped_summary(weak, why, threshold, model).first().asDict() | {"similarity_distribution": "not_available"}
        empty = similarity.candidates(weak).withColumn("clip_similarity", F.lit(None).cast("double")).filter("false")
        tables.write_table(similarity.retained(empty, threshold, model), target, fmt)
    else:
        scores, seen = similarity.observed(similarity.scored_by(similarity.candidates(weak), scorer), threshold)
        tables.write_table(similarity.retained(scores, threshold, model), target, fmt)
        s = dict(seen.get)
        s["retention_rate"] = contract.retention(s)
        spread = {"count": s["scored_pairs"], "min": s.pop("min"), "mean": s.pop("mean"), "max": s.pop("max")}
        result = {"status": "completed", "reason": "all candidates were scored", "input_groups": weak.count(), **s, "threshold": threshold, "model_id": model, "similarity_distribution": spread if s["scored_pairs"] else "not_available"}
    tables.write_json(f"{paths['processed_dir']}/clip_denoising_summary.json", result)
    return result


def run_report(config: dict) -> str:
    paths = config["paths"]
    text = contract.report(config, tables.read_json(f"{paths['processed_dir']}/dataset_statistics.json"), tables.read_json(f"{paths['interim_dir']}/validation_summary.json"), tables.read_json(f"{paths['processed_dir']}/clip_denoising_summary.json"))
    Path(paths["report_path"]).parent.mkdir(parents=True, exist_ok=True)
    Path(paths["report_path"]).write_text(text, encoding="utf-8")
    return paths["report_path"]


def prepare_subset(spark: SparkSession, raw: str, out: str, most: int | None = None, reviews_each: int = 5, include_closed: bool = False) -> dict:
    """A small catalog with reviews and photos as JSON lines, and its manifest."""
    names = {"business": ["yelp_academic_dataset_business.json", "business.json"], "review": ["yelp_academic_dataset_review.json", "review.json"], "photo": ["photos.json", "photo.json", "yelp_academic_dataset_photo.json"]}
    path = {k: tables.first_existing(spark, raw, v, k != "photo") for k, v in names.items()}
    load = lambda k, schema: tables.ordered(tables.strict_json(spark, path[k], schema), parquet=False)
    chosen = catalog.selected(parse.identified(parse.businesses(load("business", BUSINESS)), "business_id"), most, include_closed)
    tables.write_json_lines(catalog.places(chosen), f"{out}/poi_catalog.jsonl")
    places = spark.read.schema(catalog.places(chosen).schema).json(f"{out}/poi_catalog.jsonl")
    reviews = catalog.place_reviews(load("review", REVIEW), places, reviews_each)
    items = catalog.place_photos(load("photo", PHOTO), places) if path["photo"] else spark.createDataFrame([], "item_id string, photo_id string")
    tables.write_json_lines(reviews, f"{out}/reviews.jsonl")
    tables.write_json_lines(items, f"{out}/multimodal_items.jsonl")
    manifest = catalog.manifest(places, reviews, items)
    tables.write_json(f"{out}/manifest.json", manifest | {"sources": path})
    return manifest


def vector_scorer(image_vectors: dict[str, list[float]], text_vectors: dict[str, list[float]]):
    """A scorer from small dictionaries of vectors, for tests and demonstrations."""
    as_map = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def score(path: Column, text: Column) -> Column:
        return similarity.cosine(as_map(image_vectors)[path], as_map(text_vectors)[text])

    return score
