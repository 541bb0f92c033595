"""Operators on small rows: rules, edges, files, the whole pipeline and the service."""

import io
import json
import tarfile
import threading
import urllib.error
import urllib.request
import zipfile

import pytest
from pyspark.sql import functions as F

from placeloom.functions import attributes as A
from placeloom.functions import modelout as M
from placeloom.functions import text as X
from placeloom.operators import align, catalog, contract, parse, planning, retrieval, similarity, stats
from placeloom.plans import place_pipeline as P
from placeloom.plans.reference import _png_bytes
from placeloom.service import Service, serve
from placeloom.sources import archives, images, settings, tables
from placeloom.streaming import reviews as stream_reviews


def values(df, *cols):
    return [tuple(r[c] for c in (cols or df.columns)) for r in df.collect()]


# ---- functions


def test_strip_and_symbols(spark):
    texts = ["\u3000\x1c a b \u00a0\n", "!!! ---", "½ ² ①", "_", "é", "", "‿", "中"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert values(df.select(X.strip(F.col("t")))) == [("a b",), ("!!! ---",), ("½ ² ①",), ("_",), ("é",), ("",), ("‿",), ("中",)]
    assert [r[0] for r in values(df.select(X.symbols_only(X.strip(F.col("t")))))] == [False, True, False, True, False, False, True, False]


def test_categories_and_tokens(spark):
    df = spark.createDataFrame([(" Cafes, Coffee & Tea ,,\tX",), (None,), ("",)], "t string")
    assert values(df.select(X.categories(F.col("t")))) == [(["cafes", "coffee & tea", "x"],), ([],), ([],)]
    assert values(df.select(X.ascii_tokens(F.lit("Größe_1 Ab-c 中文")))).pop(0) == (["gr", "e_1", "ab", "c"],)


def test_attributes(spark):
    attrs = json.dumps({"WiFi": "free", "BusinessParking": "{'garage': False, 'lot': True, 'x': None}", "Other": "y", "GoodForKids": "None", "Ambience": "{u'hip': True}"})
    row = spark.createDataFrame([(attrs, '{"Mon":"9-5"}'), ("nonsense", None), (None, "[]")], "a string, h string")
    m = A.as_map(F.col("a"))
    got = values(row.select(A.flattened(m).alias("f"), A.dimension_labels(m, A.as_map(F.col("h"))).alias("l")))
    assert {"attr_WiFi": "free", "attr_BusinessParking_garage": "false", "attr_BusinessParking_lot": "true", "attr_GoodForKids": "None"}.items() <= got[0][0].items()
    assert "attr_Other" not in got[0][0] and got[0][1] == ["Ambience", "BusinessParking", "Other", "WiFi", "hours"]
    assert got[1] == ({}, []) and got[2] == ({}, [])
    lits = spark.createDataFrame([("{u'a': \"it's\"}",), ("[1, None]",), ("plain",), ("{bad",), (None,)], "v string")
    assert [r[0] for r in values(lits.select(A.python_literals("v")))] == ['{"a": "it\'s"}', "[1, null]", "plain", "{bad", None]


def test_description_skips_what_is_empty(spark):
    df = spark.createDataFrame([("N", ["a", "b"], "", None, 4.0, '{"b":"1","a":"2","c":"3","d":"4","e":"5","f":"6"}', '{"Tue":"1","Mon":"2"}'), (None, [], None, None, None, None, None)], "name string, c array<string>, city string, st string, stars double, a string, h string")
    got = values(df.select(A.description(F.col("name"), F.col("c"), F.col("city"), F.col("st"), F.col("stars"), A.as_map(F.col("a")), A.as_map(F.col("h")))))
    assert got == [("N | a, b | rated 4.0 | a: 2, b: 1, c: 3, d: 4, e: 5 | hours: Mon 2, Tue 1",), ("",)]


def test_model_output():
    assert M.normalised('```json\n{"objects":[{"name":"cup"},"x",null,{"z":1}],"style":"warm","confidence":0.9,"image_summary":"s"}\n```') | {"raw_model_output": ""} == {
        "image_summary": "s", "confidence": 0.9, "raw_model_output": "",
        "structured_info": {"objects": ["cup", "x"], "style": ["warm"], "ocr_text": [], "location_clues": [], "travel_intent": [], "merchant_type": None, "poi_type": None, "scene": None},
    }
    assert M.normalised("no json")["confidence"] == 0.3 and M.normalised("[1]")["image_summary"] == "[1]" and M.normalised("{}")["confidence"] == 0.5
    assert M.file_url_path("file:///C:/x y.png") == "C:/x y.png" and M.file_url_path("file://host/a%20b") == "host/a b" and M.embedded_image("http://x") == "http://x"


def test_fences_agree(spark):
    texts = ["```json\n{}\n```", " ``` \nx\n ``` ", "{}", "```", "```\na\n```\nb", "a\n```"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in values(df.select(M.without_fence(F.col("t"))))] == [M.bare(t) for t in texts]


def test_embedded_image(tmp_path):
    (tmp_path / "a.png").write_bytes(_png_bytes(2))
    assert M.embedded_image(f"file://{tmp_path}/a.png").startswith("data:image/png;base64,iVBOR")
    assert M.embedded_image(f"file://{tmp_path}/none.png") == f"file://{tmp_path}/none.png"


# ---- operators


def test_first_rule_wins(spark):
    rows = [("r", "b", "  good enough text here "), (None, "b", ""), ("", "b", "x"), ("r", None, "!!"), ("r", "b", None), ("r", "b", " \u3000"), ("r", "b", "?!"), ("r", "b", "short"), ("r", "b", "½½")]
    got = parse.with_reason(spark.createDataFrame(rows, "review_id string, business_id string, text string"), 10)
    assert [r.filter_reason for r in got.collect()] == [None, *["missing_identifier"] * 3, "empty", "empty", "symbol_only", "too_short", "too_short"]
    n = parse.review_counts(got).first().asDict()
    assert n["input_reviews"] == len(rows) == sum(v for k, v in n.items() if k != "input_reviews")
    assert parse.with_reason(got, 1, reject_symbols=False).filter("filter_reason is null").count() == 4


def test_stats_skip_null_stars(spark):
    df = spark.createDataFrame([("a", 4.0), ("a", None), ("b", None)], "business_id string, stars double")
    assert sorted(values(parse.review_stats(df))) == [("a", 2, 4.0), ("b", 1, None)]


def test_alignment(spark):
    photos = spark.createDataFrame([("p1", "b1", "cap", "food", "x", 1), ("p2", "b1", "  ", "x", "x", 2), ("p3", "b1", "bad", "x", "x", 3), ("p4", "b2", "cap", "", "x", 4), (None, "b1", "cap", "x", "x", 5)], "photo_id string, business_id string, caption string, label string, image_path string, ord long")
    index = spark.createDataFrame([("p1", "b1", "i1", True, 1), ("p2", "b1", "i2", True, 2), ("p3", "b1", "i3", False, 3), ("p4", "b2", "old", True, 4), ("p4", "b2", "i4", True, 5), (None, "b1", "i", True, 6)], "photo_id string, business_id string, image_path string, image_valid boolean, ord long")
    reviews = spark.createDataFrame([("r1", "b1", "t1", 1), ("r2", "b1", "t2", 2), ("r3", "b1", "t3", 3), ("r4", "b3", "t4", 4)], "review_id string, business_id string, text string, ord long")
    ok = align.valid_images(index)
    assert sorted(values(ok, "photo_id", "image_path")) == [("p1", "i1"), ("p2", "i2"), ("p4", "i4")]
    assert sorted(values(align.strong(photos, ok), "photo_id", "image_path")) == [("p1", "i1"), ("p4", "i4")]
    weak = align.weak(photos, ok, reviews, 2, 1).collect()
    assert [(w.business_id, w.photo_ids, w.review_ids, w.review_texts) for w in weak] == [("b1", ["p1"], ["r1", "r2"], ["t1", "t2"])]
    assert sorted(values(align.bounded_reviews(reviews, ok, 2), "review_id")) == [("r1",), ("r2",)]


def test_similarity(spark):
    weak = spark.createDataFrame([("b", ["p1", "p2", None], ["i1", "i2", "i3"], ["r1", "r2", "r3"], [" t1 ", "", "t3"]), ("c", [], [], ["r"], ["t"])], "business_id string, photo_ids array<string>, image_paths array<string>, review_ids array<string>, review_texts array<string>")
    pairs = similarity.candidates(weak)
    assert sorted(values(pairs, "photo_id", "review_id", "review_text")) == [("p1", "r1", "t1"), ("p1", "r3", "t3"), ("p2", "r1", "t1"), ("p2", "r3", "t3")]
    scorer = P.vector_scorer({"i1": [1.0, 0.0], "i2": [0.0, 1.0]}, {"t1": [1.0, 0.0], "t3": [0.6, 0.8]})
    scores = similarity.scored_by(pairs, scorer)
    assert sorted(values(similarity.retained(scores, 0.5), "photo_id", "review_id")) == [("p1", "r1"), ("p1", "r3"), ("p2", "r3")]
    s = similarity.summary(scores, 0.5).first()
    assert (s.input_pairs, s.scored_pairs, s.retained_pairs, s.retention_rate) == (4, 4, 3, "75.00%")
    odd = spark.createDataFrame([(float("nan"),), (None,), (0.25,), (0.2,)], "clip_similarity double").withColumns({c: F.lit("x") for c in ("business_id", "photo_id", "image_path", "review_id", "review_text")})
    assert similarity.retained(odd).count() == 2 and similarity.summary(odd).first().skipped_candidates == 1
    assert similarity.skipped_summary(weak, "off").first().input_pairs == 4
    with pytest.raises(ValueError):
        similarity.batch_number(odd, 0, "clip_similarity")
    assert values(spark.range(1).select(similarity.retention_rate(F.lit(0), F.lit(0)))) == [("0.00%",)]


def test_retention_rate_rounds_as_sql_does(spark):
    df = spark.createDataFrame([(k, g) for g in (160, 4000) for k in range(g + 1)], "kept long, given long")
    got = df.select("kept", "given", similarity.retention_rate(F.col("kept"), F.col("given")).alias("rate")).collect()
    assert [r for r in got if r.rate != f"{100.0 * r.kept / r.given:.2f}%"] == []


def test_statistics(spark):
    b = spark.createDataFrame([("a", ["x", "y"], 1), ("b", ["y", "x"], 2), ("c", ["z", "z"], 3)], "business_id string, categories array<string>, ord long")
    assert values(stats.top_values(b, "categories", "ord")) == [("x", 2), ("y", 2), ("z", 2)]
    none = spark.createDataFrame([(" ",), (None,)], "caption string")
    assert values(stats.caption_lengths(none)) == [(0, None, None, None)]
    assert values(stats.weak_first_categories(spark.createDataFrame([("a",), ("b",), ("q",)], "business_id string"), b)) == [("x", 1), ("y", 1)]
    assert sorted(values(stats.failure_types(spark.createDataFrame([("t",), (None,)], "error_type string")))) == [("t", 1), ("unknown", 1)]


def test_catalog(spark):
    rows = [("b1", "N", ["cafes", "food"], 1), ("b2", "M", ["food"], None), ("b3", "L", ["food"], 0), ("b4", "K", ["dentists"], 1)]
    df = spark.createDataFrame([(i, n, "C", "S", 1.0, 2.0, 3.0, 4, c, o, k) for k, (i, n, c, o) in enumerate(rows)], "business_id string, name string, city string, state string, latitude double, longitude double, stars double, review_count long, categories array<string>, is_open int, ord long").withColumn("attributes", F.lit("{}"))
    assert values(catalog.selected(df), "business_id") == [("b1",), ("b2",)]
    assert values(catalog.selected(df, include_closed=True), "business_id") == [("b1",), ("b2",), ("b3",)]
    assert values(catalog.selected(df, 0)) == []
    p = catalog.places(catalog.selected(df, 1)).first()
    assert (p.poi_id, p.category, p.tags, p.description) == ("poi_b1", "Cafe", ["cafes", "food"], "N Cafe C S")


def test_retrieval(spark):
    items = spark.createDataFrame([(1, "cozy cafe", 1), (2, "Cafe cozy cozy", 2), (3, "museum", 3), (4, "", 4)], "item_id long, text string, ord long")
    asked = spark.createDataFrame([(0, "Cozy CAFE x"), (1, "中文"), (2, "museum museum")], "query_id long, text string")
    got = values(retrieval.search(asked, items, 2).orderBy("query_id", "rank"))
    assert got == [(0, 1, 0.6667, ["cafe", "cozy"], 1), (0, 2, 0.6667, ["cafe", "cozy"], 2), (2, 3, 1.0, ["museum"], 1)]
    m = spark.createDataFrame([(["a", "b"], ["a", "c", "b"]), ([], ["a"])], "e array<string>, r array<string>")
    assert values(m.select(retrieval.recall_at_k(F.col("e"), F.col("r"), 2), retrieval.top_k_hit(F.lit("b"), F.col("r"), 2), retrieval.top_k_hit(F.lit("b"), F.col("r"), 3))) == [(0.5, 0, 1), (0.0, 0, 0)]


def test_planning(spark):
    c = spark.createDataFrame([(1, i, f"n{i}" if i else None, "Cafe" if i == 1 else None) for i in range(6)], "trip_id long, ord long, name string, category string")
    t = spark.createDataFrame([(1, "X", None, ["CAFE"]), (2, None, "compact", None)], "trip_id long, city string, pace string, interests array<string>")
    one, two = planning.itineraries(c, t).orderBy("trip_id").collect()
    assert [s.time for s in one.itinerary] == [*planning.RELAXED, *planning.RELAXED[:2]]
    assert (one.itinerary[0].poi_name, one.itinerary[0].poi_type, one.itinerary[1].reason) == ("Unknown POI", "POI", "Matches user interest in cafe.")
    assert (one.summary, one.confidence, two.summary, two.confidence, two.itinerary) == ("Relaxed 1 day itinerary for X.", 0.72, "Compact 1 day itinerary for Unknown city.", 0.3, [])


# ---- files


def test_json_lines(spark, tmp_path):
    lines = ['{"a": 1}', "", "  ", "[1]", "null", '"s"', '{"a":1} x', "{bad", '{"a":1,"a":2}', '{"a": NaN}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n")
    got = tables.json_lines(spark, f"{tmp_path}/x.jsonl")
    assert values(tables.line_counts(got)) == [(10, 3, 5)]
    assert values(tables.json_records(got, "a double").orderBy("ord"), "a")[0] == (1.0,)
    assert tables.json_lines(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        tables.strict_json(spark, f"{tmp_path}/x.jsonl", "a double").collect()
    with pytest.raises(FileNotFoundError):
        tables.first_existing(spark, str(tmp_path), ["q"])
    assert tables.first_existing(spark, str(tmp_path), ["q"], required=False) is None


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("08540", 1, True, ['a"b', "c,\nd"], {"k": "v"}), (None, None, None, None, None)], "id string, n long, b boolean, l array<string>, m map<string,string>")
    for fmt in ("parquet", "csv"):
        assert tables.write_table(df, f"{tmp_path}/t.{fmt}", fmt)["rows"] == 2
        back = tables.read_table(spark, f"{tmp_path}/t.{fmt}", "id string, n long, b boolean, l array<string>, m map<string,string>")
        assert sorted(map(repr, values(back))) == sorted(map(repr, values(df)))
    assert tables.write_table(df.filter("false"), f"{tmp_path}/e.parquet")["rows"] == 0
    assert tables.inspect(spark, f"{tmp_path}/e.parquet") == (0, df.columns)
    assert tables.is_parquet(spark, f"{tmp_path}/t.parquet") and not tables.is_parquet(spark, f"{tmp_path}/t.csv")
    with pytest.raises(ValueError):
        tables.write_table(df, "x", "orc")


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(_png_bytes(3))
    (tmp_path / "b.png").write_bytes(_png_bytes(3)[:-20])
    jpeg = b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x03\x00\x02\x01\x01\x11\x00\xff\xda\x00\x02data\xff\xd9"
    assert images._jpeg(jpeg) == (2, 3)
    with pytest.raises(ValueError):
        images._jpeg(jpeg[:-2])
    photos = spark.createDataFrame([("a", f"{tmp_path}/a.png"), ("b", f"{tmp_path}/b.png"), ("c", f"{tmp_path}/c.png"), ("d", ""), ("e", None)], "photo_id string, image_path string").withColumn("business_id", F.lit("x"))
    index = images.image_index(photos, str(tmp_path))
    rows = {r.photo_id: r for r in index.collect()}
    assert (rows["a"].image_valid, rows["a"].image_width, rows["a"].image_height) == (True, 3, 1)
    assert rows["b"].validation_error.startswith("corrupted") and [rows[k].validation_error for k in "cde"] == ["missing"] * 3
    assert values(images.image_counts(index)) == [(5, 1, 3, 1)]


def test_archives(tmp_path):
    packed = io.BytesIO()
    with tarfile.open(fileobj=packed, mode="w:gz") as t:
        for name, body in (("./photos.json", b"{}"), ("d/photos/p1.jpg", b"1"), ("photos/p2.jpg", b"22"), ("d/._photos.json", b"x"), ("other.json", b"x")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/data.tar.gz", packed.getvalue())
        z.writestr("__MACOSX/in/._data.tar", b"x")
        z.writestr("Dataset_documentation.pdf", b"doc")
    found = archives.extract_members(tmp_path / "z.zip", tmp_path / "a")
    assert [f["member"] for f in found] == ["photos.json"]
    assert {f["member"] for f in archives.extract_members(tmp_path / "z.zip", tmp_path / "b", (), True)} == {"d/photos/p1.jpg", "photos/p2.jpg"}
    assert [f["bytes"] for f in archives.extract_members(tmp_path / "z.zip", tmp_path / "c", (), photo_ids={"p2"})] == [2]
    assert archives.extract_all(tmp_path / "z.zip", tmp_path / "d")["counts"] == {"json": 1, "documents": 1, "photos": 0}
    with pytest.raises(ValueError):
        archives.target(tmp_path, "../out")
    assert archives.is_resource_fork("./._x") and archives.is_resource_fork("__MACOSX/a") and not archives.is_resource_fork("a/b._c")


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("# note\noutput:\n  format: csv\nweak_alignment:\n  max_reviews_per_business: 2\nx: 'y'\nflag: true\nz: null\nf: 0.5\n")
    got = settings.load(tmp_path / "c.yaml")
    assert got["output"]["format"] == "csv" and got["weak_alignment"] == {"max_reviews_per_business": 2, "max_images_per_business": 5}
    assert (got["x"], got["flag"], got["z"], got["f"]) == ("y", True, None, 0.5)
    assert settings.load(tmp_path / "none") == settings.DEFAULTS and settings.load() is not settings.DEFAULTS
    assert settings.plain_yaml("a:\n  b:\n    c: 1\n  d: 2\n") == {"a": {"b": {"c": 1}, "d": 2}}
    assert settings.plain_yaml("# x\na: 'it''s # no'  # c\nb: \"1\\n\"\nc: -1.5e3\nd:\ne: http://x:1/#y\nf: ~\n") == {"a": "it's # no", "b": "1\n", "c": -1500.0, "d": None, "e": "http://x:1/#y", "f": None}
    for bad in ("- a\n", "a: 1\n  b: 2\n", "a:\n    b: 1\n  c: 2\n", "just text\n"):
        with pytest.raises(ValueError):
            settings.plain_yaml(bad)
    assert settings.plain_yaml("") == {}


# ---- whole runs


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    write = lambda name, rows: (root / name).write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    write("business.json", [{"business_id": "b1", "name": "Cafe", "city": "X", "state": "S", "stars": 4.5, "review_count": 2, "is_open": 1, "categories": "Cafes, Food", "attributes": {"WiFi": "free", "BusinessParking": "{'lot': True}"}, "hours": None}, {"name": "no id"}, "{broken"])
    write("review.json", [{"review_id": f"r{i}", "business_id": "b1", "stars": i, "text": t} for i, t in enumerate(["a long enough review text", "short", "?!?!", "", "another long enough review"])])
    write("photos.json", [{"photo_id": "p1", "business_id": "b1", "caption": "nice", "label": "food"}, {"photo_id": "p2", "business_id": "b1"}, {"business_id": "b1"}])
    (root / "photos").mkdir()
    (root / "photos" / "p1.jpg").write_bytes(_png_bytes(4))
    return root


def test_pipeline_end_to_end(spark, raw, tmp_path):
    config = settings.merged(settings.DEFAULTS, {"paths": {"business_json": f"{raw}/business.json", "review_json": f"{raw}/review.json", "photo_json": f"{raw}/photos.json", "image_root": f"{raw}/photos", **{k: f"{tmp_path}/{k}" for k in ("interim_dir", "processed_dir", "validation_dir", "logs_dir")}, "report_path": f"{tmp_path}/r/report.md"}, "clip_denoising": {"enabled": True}})
    summary = P.run_parse(spark, config)
    assert summary["lines"]["business"] == {"total_lines": 3, "records": 2, "malformed_lines": 1}
    assert summary["review_filters"] == {"input_reviews": 5, "valid_reviews": 2, "filtered_missing_identifier": 0, "filtered_empty": 1, "filtered_symbol_only": 1, "filtered_too_short": 1}
    assert summary["image_validation"] == {"total_images": 2, "valid_images": 1, "missing_images": 1, "corrupted_images": 0}
    found = P.run_alignment(spark, config)
    assert (found["strong_pairs"], found["medium_pairs"], found["weak_pairs"], found["valid_image_ratio"], found["city_count"]) == (1, 1, 1, 0.5, 1)
    clip = P.run_denoising(spark, config, lambda path, text: F.when(text.startswith("a long"), 0.8).otherwise(0.1))
    assert (clip["input_pairs"], clip["retained_pairs"], clip["similarity_distribution"]["max"]) == (2, 1, 0.8)
    P.run_report(config)
    assert contract.check_outputs(spark, config)["errors"] == []
    (raw / "photos" / "p1.jpg").rename(raw / "photos" / "gone.png")
    assert contract.check_outputs(spark, config)["status"] == "failed"
    (raw / "photos" / "gone.png").rename(raw / "photos" / "p1.jpg")
    off = P.run_denoising(spark, settings.merged(config, {"clip_denoising": {"enabled": False}}))
    assert (off["status"], off["input_pairs"]) == ("skipped", 2) and spark.read.parquet(f"{tmp_path}/processed_dir/weak_pairs_denoised.parquet").count() == 0


def test_report_says_todo():
    text = contract.report(settings.DEFAULTS, {})
    assert text.count("TODO") > 20 and text.count("## ") == 10
    assert contract.retention({"input_pairs": 0, "retained_pairs": 0}) == "0.00%"


def test_subset_and_service(spark, raw, tmp_path):
    good = tmp_path / "raw"
    good.mkdir()
    for name in ("review.json", "photos.json"):
        (good / name).write_text("".join(x + "\n" for x in (raw / name).read_text().splitlines() if x))
    (good / "business.json").write_text((raw / "business.json").read_text().splitlines()[0] + "\n")
    assert P.prepare_subset(spark, str(good), str(tmp_path / "out"), reviews_each=3) == {"business_count": 1, "review_count": 3, "multimodal_item_count": 2}
    catalog_path = str(tmp_path / "out" / "poi_catalog.jsonl")
    service = Service(spark, catalog_path)
    found = service.visual_search({"query_text": "", "image_urls": ["http://x/a.jpg"], "top_k": 3})
    assert found["query_understanding"]["merchant_type"] == "cafe" and found["results"][0]["matched_reasons"] == ["cafe"]
    assert service.travel_planning({"preferences": {"city": "X"}})["confidence"] == 0.72
    assert Service(spark).travel_planning({})["itinerary"] == []
    told = Service(spark, ask=lambda payload: '{"objects": ["a"], "confidence": 0.9}' if payload["messages"] else "").image_understanding({"image_urls": ["u"]})
    assert (told["structured_info"]["objects"], told["confidence"]) == (["a"], 0.9)

    def broken(payload):
        raise OSError("down")

    assert "down" in Service(spark, ask=broken).image_understanding({"user_text": "Museum"})["raw_model_output"]
    server = serve(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert json.load(urllib.request.urlopen(f"{url}/health"))["status"] == "ok"
    asked = urllib.request.Request(f"{url}/v1/image-understanding", b'{"user_text": "museum"}')
    assert json.load(urllib.request.urlopen(asked))["structured_info"]["merchant_type"] == "museum"
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"{url}/none")
    server.shutdown()


def test_stream(spark, raw, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "r.json").write_text((raw / "review.json").read_text())
    schema = "review_id string, business_id string, stars double, text string"
    q = stream_reviews.write_valid(stream_reviews.read_reviews(spark, str(folder), schema), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    assert stream_reviews.stats_updates(stream_reviews.read_reviews(spark, str(folder), schema)).isStreaming


def test_images_are_joined_by_their_path(spark, tmp_path):
    from placeloom.plans.reference import _png_bytes

    for folder, width in (("a", 2), ("b", 3)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "1.png").write_bytes(_png_bytes(width))
    rows = [("p", "x", f"{tmp_path}/a/1.png"), ("q", "x", f"file://{tmp_path}/b/1.png"), ("r", "x", f"{tmp_path}/c/1.png"), ("s", "x", "b/1.png")]
    photos = spark.createDataFrame(rows, "photo_id string, business_id string, image_path string")
    got = {r.photo_id: r.image_width for r in images.image_index(photos, str(tmp_path)).collect()}
    assert got == {"p": 2, "q": 3, "r": None, "s": 3}
    there = contract.image_files(spark, str(tmp_path))
    assert [r.photo_id for r in contract.without_file(photos, "image_path", there, str(tmp_path)).collect()] == ["r"]


def test_batches_count_over_the_whole_table(spark):
    df = spark.range(1000).repartition(7)
    rows = similarity.batch_number(df, 64, "id", ranges=8).collect()
    assert all(r.batch == r.id // 64 for r in rows) and len(rows) == 1000
    assert similarity.batch_number(df.filter("id < 0"), 64, "id").count() == 0


def test_no_views_are_left(spark):
    from placeloom.plans import roles

    before = {t.name for t in spark.catalog.listTables()}
    roles.reviews_df(spark, "/root/testdata/sf0.001").count()
    assert {t.name for t in spark.catalog.listTables()} == before
