"""Checks of a run's outputs, and the report."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables

#: Tables of a run: layer, file and columns they must have.
EXPECTED = {
    "business": ("interim_dir", "business", {"business_id", "name", "categories", "attributes", "hours"}),
    "reviews": ("interim_dir", "reviews", {"review_id", "business_id", "text", "stars"}),
    "photos": ("interim_dir", "photos", {"photo_id", "business_id", "caption", "label", "image_path"}),
    "image_index": ("interim_dir", "photo_image_index", {"photo_id", "image_path", "image_valid", "validation_error"}),
    "review_stats": ("interim_dir", "review_business_stats", {"business_id", "valid_review_count", "average_review_stars"}),
    "strong_pairs": ("processed_dir", "strong_image_caption_pairs", {"pair_id", "photo_id", "image_path", "caption", "alignment_type"}),
    "medium_pairs": ("processed_dir", "image_business_attribute_pairs", {"pair_id", "photo_id", "image_path", "business_description", "attribute_dimension_labels"}),
    "weak_pairs": ("processed_dir", "business_level_weak_pairs", {"pair_id", "business_id", "photo_ids", "image_paths", "review_ids", "review_texts"}),
}
DENOISED = {"business_id", "photo_id", "image_path", "review_id", "review_text", "clip_similarity", "clip_model", "alignment_type"}


def missing_columns(df: DataFrame, required: set[str]) -> list[str]:
    return sorted(required - set(df.columns))


def without_file(rows: DataFrame, path: str, files: DataFrame, root: str = "") -> DataFrame:
    """Rows whose path is empty or names no file. ``files`` has file: paths under ``root``."""
    own = tables.under(rows.sparkSession, root, F.col(path)) if root else F.col(path)
    return rows.withColumn("_file", F.coalesce(own, F.lit(""))).join(files.select(F.col("file").alias("_file")).distinct(), "_file", "left_anti").drop("_file")


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """file: the path of each file under ``root``, relative to it; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(tables.under(spark, root, F.col("path")).alias("file"))


def check_outputs(spark: SparkSession, settings: dict) -> dict:
    """status, errors, warnings, counts, columns and files of a run."""
    paths, fmt = settings["paths"], settings["output"]["format"]
    errors, warnings, counts, columns, files, there = [], [], {}, {}, {}, None
    noted = {o.get("path"): o for o in tables.read_json(f"{paths['interim_dir']}/validation_summary.json").get("outputs") or []}
    report = Path(paths["report_path"])
    for name, (layer, file, required) in EXPECTED.items():
        files[name] = path = f"{paths[layer]}/{file}.{fmt}"
        if not tables.exists(spark, path):
            errors.append(f"missing table {name}: {path}")
            counts[name], columns[name] = 0, []
            continue
        df = tables.read_table(spark, path)
        counts[name], columns[name] = df.count(), sorted(df.columns)
        if lost := missing_columns(df, required):
            errors.append(f"{name} lacks columns {lost}")
        elif name in ("strong_pairs", "medium_pairs", "weak_pairs") and tables.exists(spark, paths["image_root"]):
            there = there or tables.stored(image_files(spark, paths["image_root"]), "image-files")  # listed once
            one = df if name != "weak_pairs" else df.select("pair_id", F.explode("image_paths").alias("image_path"))
            if bad := without_file(one, "image_path", there, paths["image_root"]).orderBy("pair_id").first():
                errors.append(f"{name}: {bad.pair_id} has no image file: {bad.image_path}")
        if fmt == "parquet" and not tables.is_parquet(spark, path):
            note = noted.get(path) or {}
            if note.get("actual_format") != "csv_fallback" or not note.get("error"):
                errors.append(f"{name} is not Parquet: {path}")
            elif not report.exists() or "CSV fallback" not in report.read_text(encoding="utf-8"):
                errors.append(f"{name} fell back to CSV, which the report does not say")
            else:
                warnings.append(f"{name} fell back to CSV: {note['error']}")
    errors += check_denoised(spark, settings)
    if not report.exists():
        errors.append(f"missing report: {report}")
    else:
        text = report.read_text(encoding="utf-8")
        errors += [f"the report lacks the count of {n}: {counts[n]}" for n in ("business", "reviews", "photos", "strong_pairs", "medium_pairs", "weak_pairs") if str(counts[n]) not in text]
        if "Parquet" not in text and "CSV" not in text:
            warnings.append("the report does not name the storage format")
    return {"status": "failed" if errors else "ok", "errors": errors, "warnings": warnings, "counts": counts, "columns": columns, "files": files}


def check_denoised(spark: SparkSession, settings: dict) -> list[str]:
    """Errors of the denoised table and its summary; none where denoising is off and left nothing."""
    paths, own = settings["paths"], settings["clip_denoising"]
    summary = Path(paths["processed_dir"]) / "clip_denoising_summary.json"
    if not summary.exists():
        return [f"missing summary: {summary}"] if own.get("enabled") else []
    table = f"{paths['processed_dir']}/{own.get('output_filename', 'weak_pairs_denoised')}.{settings['output']['format']}"
    if not tables.exists(spark, table):
        return [f"missing table: {table}"]
    df = tables.read_table(spark, table)
    errors = [f"the denoised table lacks columns {lost}"] if (lost := missing_columns(df, DENOISED)) else []
    kept, rows = int(json.loads(summary.read_text(encoding="utf-8")).get("retained_pairs", 0)), df.count()
    if kept != rows:
        errors.append(f"the summary says {kept} retained pairs, the table has {rows}")
    if not errors and rows and tables.exists(spark, paths["image_root"]) and (bad := without_file(df, "image_path", image_files(spark, paths["image_root"]), paths["image_root"]).first()):
        errors.append(f"a denoised pair has no image file: {bad.image_path}")
    return errors


def retention(summary: dict) -> str:
    given, kept = summary.get("input_pairs"), summary.get("retained_pairs")
    if not isinstance(given, int | float) or not isinstance(kept, int | float):
        return "TODO"
    return f"{kept / given:.2%}" if given > 0 else "0.00%"


def report(settings: dict, stats: dict, validation: dict | None = None, clip: dict | None = None) -> str:
    """The Markdown report of a run in ten sections; what was not measured says TODO."""
    validation, clip = validation or {}, clip or {}
    get = lambda d, k: "TODO" if d.get(k) is None else d[k]
    formats = {o.get("actual_format") for o in validation.get("outputs") or [] if isinstance(o, dict)}
    lost = [o for o in validation.get("outputs") or [] if isinstance(o, dict) and o.get("actual_format") == "csv_fallback"]
    storage = f"CSV fallback for {len(lost)} tables: {lost[0].get('error')}" if lost else "CSV files" if "csv" in formats else "Parquet files" if "parquet" in formats else "TODO"
    limit = settings.get("processing_limits", {}).get("max_reviews")
    rejects, images = validation.get("review_filters", {}), validation.get("image_validation", {})
    section = lambda n, title, *lines: [f"## {n}. {title}", *(f"- {x}" for x in lines), ""]
    out = ["# Place data: processing report", ""]
    out += section(1, "Scope", *(f"{label}: {get(stats, key)}" for label, key in (("businesses", "business_count"), ("reviews", "review_count"), ("photos", "photo_metadata_count"), ("valid images", "valid_image_count"), ("cities", "city_count"))))
    out += section(2, "Inputs", *(f"{k}: `{v}`" for k, v in settings.get("paths", {}).items() if k.endswith("_json") or k == "image_root"), f"review limit: {'none, all reviews' if limit in (None, '', 'null', 'None') else limit}")
    out += section(3, "Storage", storage)
    out += section(4, "Review filters", *(f"{k}: {get(rejects, k)}" for k in ("input_reviews", "valid_reviews", "filtered_missing_identifier", "filtered_empty", "filtered_symbol_only", "filtered_too_short")))
    out += section(5, "Images", *(f"{k}: {get(images, k)}" for k in ("total_images", "valid_images", "missing_images", "corrupted_images")), f"valid image ratio: {get(stats, 'valid_image_ratio')}", f"businesses with reviews: {get(stats, 'businesses_with_reviews')}", f"businesses with valid images: {get(stats, 'businesses_with_valid_images')}", f"top categories: {get(stats, 'top_categories')}")
    out += section(6, "Strong pairs", f"pairs: {get(stats, 'strong_pairs')}", f"labels: {get(stats, 'photo_label_distribution')}", f"caption lengths: {get(stats, 'caption_length_stats')}")
    out += section(7, "Medium pairs", f"pairs: {get(stats, 'medium_pairs')}")
    out += section(8, "Weak groups", f"groups: {get(stats, 'weak_pairs')}", f"first categories: {get(stats, 'weak_group_top_categories')}")
    out += section(9, "Denoising", f"status: {get(clip, 'status')} ({get(clip, 'reason')})", f"pairs: {get(clip, 'input_pairs')} -> {get(clip, 'retained_pairs')}", f"retention rate: {retention(clip)}", f"threshold: {get(clip, 'threshold')}", f"similarity: {clip.get('similarity_distribution', 'not_available')}")
    out += section(10, "Outputs", *(f"{file}.{settings['output']['format']}: {name}" for name, (_, file, _) in EXPECTED.items()))
    return "\n".join(out)
