"""The committing sink, the fallback to CSV, and whole runs in CSV."""

import json
import os

import pytest
from pyspark.sql import functions as F

from placeloom.operators import contract
from placeloom.plans import place_pipeline as P
from placeloom.sources import row_sink as S
from placeloom.sources import settings, tables
from placeloom.sources.images import png_bytes

ROWS = [(i, x, [x, None], {"k": x}, bytes([i, 255]), i % 2 == 0, i / 3) for i, x in enumerate(["plain", "", None, 'q " , \\ \n two', "é 漢", "tail\r\n"])]
SCHEMA = "i int, t string, l array<string>, m map<string,string>, b binary, f boolean, d double"


def files(top):
    return sorted(os.path.relpath(os.path.join(d, f), top) for d, _, names in os.walk(top) for f in names if f.startswith("part"))


@pytest.mark.parametrize(("fmt", "compression", "actual"), [("parquet", "zstd", "parquet"), ("csv", "zstd", "csv"), ("parquet", "lzo", "csv_fallback")])
def test_round_trip(spark, tmp_path, fmt, compression, actual):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    done = S.write_rows(df, str(tmp_path), fmt, compression=compression)
    assert (done["rows"], done["requested_format"], done["actual_format"]) == (6, fmt, actual) and (done["error"] is None) == (actual != "csv_fallback")
    back = S.read_rows(spark, str(tmp_path))
    assert back.schema == df.schema and sorted(map(tuple, back.collect())) == [(*r[:4], bytearray(r[4]), *r[5:]) for r in ROWS]
    S.write_rows(df.filter("i < 2"), str(tmp_path), fmt, "append", compression)
    assert S.read_rows(spark, str(tmp_path)).count() == 8
    S.write_rows(df.filter("i < 1"), str(tmp_path), fmt)
    assert S.read_rows(spark, str(tmp_path)).count() == 1 == len(files(tmp_path))
    S.write_rows(df.filter("false"), str(tmp_path), fmt)
    assert S.read_rows(spark, str(tmp_path)).count() == 0 and S.read_rows(spark, str(tmp_path)).columns == df.columns


def test_failed_tasks_leave_no_rows(spark, tmp_path):
    df = spark.createDataFrame([(i,) for i in range(40)], "i int").repartition(4)
    S.write_rows(df, str(tmp_path))
    bad = df.select((F.lit(1) / (F.col("i") - 33)).alias("i")).select(F.col("i").cast("int").alias("i"))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        S.write_rows(bad, str(tmp_path), mode="append")
    assert S.read_rows(spark, str(tmp_path)).count() == 40 == S.manifest(str(tmp_path))["rows"]
    assert {f["file"] for f in S.manifest(str(tmp_path))["files"]} <= set(files(tmp_path))  # killed tasks may still leave files, which nobody reads
    (tmp_path / "stray").mkdir()
    (tmp_path / "stray" / "part-0.parquet").write_bytes(b"left by a lost task")
    assert S.read_rows(spark, str(tmp_path)).count() == 40


def test_refusals(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        S.read_rows(spark, str(tmp_path))
    S.write_rows(spark.range(3), str(tmp_path))
    with pytest.raises(Exception, match="columns differ"):
        S.write_rows(spark.range(3).withColumnRenamed("id", "x"), str(tmp_path), mode="append")
    with pytest.raises(Exception, match="unknown format"):
        S.write_rows(spark.range(3), str(tmp_path), "orc")


def test_table_falls_back(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    spark.conf.set("spark.sql.parquet.compression.codec", "lzo")
    try:
        done = tables.write_table(df, f"{tmp_path}/t.parquet")
        with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
            tables.write_table(df.select((F.lit(1) / F.col("i")).alias("x")), f"{tmp_path}/u.parquet")
    finally:
        spark.conf.unset("spark.sql.parquet.compression.codec")
    assert done["actual_format"] == "csv_fallback" and done["requested_format"] == "parquet" and done["error"] and done["rows"] == 6
    assert not tables.is_parquet(spark, f"{tmp_path}/t.parquet")
    back = tables.read_table(spark, f"{tmp_path}/t.parquet", order=True)
    assert [tuple(r) for r in back.orderBy("ord").drop("ord").collect()] == [(*r[:4], bytearray(r[4]), *r[5:]) for r in ROWS]


@pytest.fixture
def config(tmp_path):
    write = lambda name, rows: (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    write("business.json", [{"business_id": "b1", "name": "Cafe, the \"old\" one", "city": "X", "stars": 4.5, "categories": "Cafes, Food", "attributes": {"WiFi": "free"}, "hours": {"Monday": "9-5"}}])
    write("review.json", [{"review_id": f"r{i}", "business_id": "b1", "stars": i, "text": t} for i, t in enumerate(["a long enough,\nreview \"text\"", "?!", "another long enough review"])])
    write("photos.json", [{"photo_id": "p1", "business_id": "b1", "caption": "nice", "label": "food"}, {"photo_id": "p2", "business_id": "b1"}])
    (tmp_path / "photos").mkdir()
    (tmp_path / "photos" / "p1.jpg").write_bytes(png_bytes(3))
    paths = {"business_json": f"{tmp_path}/business.json", "review_json": f"{tmp_path}/review.json", "photo_json": f"{tmp_path}/photos.json", "image_root": f"{tmp_path}/photos", **{k: f"{tmp_path}/{k}" for k in ("interim_dir", "processed_dir", "validation_dir", "logs_dir")}, "report_path": f"{tmp_path}/r/report.md"}
    return settings.merged(settings.DEFAULTS, {"paths": paths, "clip_denoising": {"enabled": True}})


def run(spark, config):
    parsed = P.run_parse(spark, config)
    found = P.run_alignment(spark, config)
    clip = P.run_denoising(spark, config, lambda path, text: F.when(text.startswith("a long"), 0.8).otherwise(0.1))
    P.run_report(config)
    return parsed, found, (clip["input_pairs"], clip["retained_pairs"]), contract.check_outputs(spark, config)


def test_csv_run_equals_parquet_run(spark, config, tmp_path):
    parsed, found, clip, checked = run(spark, config)
    assert (found["strong_pairs"], found["medium_pairs"], found["weak_pairs"], clip, checked["errors"]) == (1, 1, 1, (2, 1), [])
    other = settings.merged(config, {"output": {"format": "csv"}, "paths": {k: f"{tmp_path}/csv/{k}" for k in ("interim_dir", "processed_dir", "validation_dir", "logs_dir", "report_path")}})
    parsed2, found2, clip2, checked2 = run(spark, other)
    assert {o["actual_format"] for o in parsed2["outputs"]} == {"csv"}
    assert (found2, clip2) == (found, clip) and (checked2["errors"], checked2["counts"], checked2["columns"]) == ([], checked["counts"], checked["columns"])
    for layer, name in (("interim_dir", "business"), ("interim_dir", "reviews"), ("processed_dir", "business_level_weak_pairs"), ("processed_dir", "weak_pairs_denoised")):
        a, b = (tables.read_table(spark, f"{c['paths'][layer]}/{name}.{c['output']['format']}") for c in (config, other))
        assert a.schema.simpleString() == b.schema.simpleString() and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert "CSV files" in open(other["paths"]["report_path"]).read()


def test_fallback_must_be_documented(spark, config):
    spark.conf.set("spark.sql.parquet.compression.codec", "lzo")
    try:
        parsed, found, clip, checked = run(spark, config)
    finally:
        spark.conf.unset("spark.sql.parquet.compression.codec")
    assert {o["actual_format"] for o in parsed["outputs"]} == {"csv_fallback"} and found["weak_pairs"] == 1 and clip == (2, 1)
    report = open(config["paths"]["report_path"]).read()
    assert "CSV fallback for 5 tables" in report
    # the pairs' tables fell back too, which no summary says
    assert len(checked["warnings"]) == 5 and all("is not Parquet" in e for e in checked["errors"]) and len(checked["errors"]) == 3
    with open(config["paths"]["report_path"], "w") as out:
        out.write(report.replace("CSV fallback", "something"))
    assert sum("does not say" in e for e in contract.check_outputs(spark, config)["errors"]) == 5
