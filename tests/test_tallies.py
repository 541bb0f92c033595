"""Tallies: parts add up to the whole, new files are added once, edge cases."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from placeloom.operators import stats, tallies

SCHEMA = "id long, city string, tags array<string>, size int, rows string, x string, o int, part int, value string"


def measures():
    return {"city": F.col("city"), "tag": F.col("tags")}, {"size": F.col("size")}


def made(seed, n=200):
    tags = ["a", "", None, "b b", "é", "A"]
    return [(i * seed % 101, [None, "", "x", "y", f"c{i % 9}"][i * seed % 5], None if i % 11 == 0 else [tags[(i + j * seed) % 6] for j in range(i % 4)], None if i % 7 == 0 else i * seed % 50 - 20, "r", "x", i, 1, "v") for i in range(n)]


def plain(rows):
    city, tag = Counter(r[1] for r in rows if r[1]), Counter(t for r in rows for t in r[2] or [] if t)
    sizes = [r[3] for r in rows if r[3] is not None]
    return {"rows": (len(rows), 0, None), "city": (sum(city.values()), len(city), None), "tag": (sum(tag.values()), len(tag), None), "size": (len(sizes), 0, (sum(sizes), min(sizes), max(sizes)))}, tag


def got(whole):
    return {r.what: (r.n, r.distinct_values, None if r.total is None else (r.total, r.least, r.most)) for r in tallies.figures(whole).collect()}


@pytest.mark.parametrize("part", [None, "id % 7", "null"])
def test_parts_add_up_to_the_whole(spark, part):
    rows = made(3)
    df = spark.createDataFrame(rows, SCHEMA)
    whole = tallies.summed(tallies.tallies(df, *measures(), "id", part=part and F.expr(part)))
    want, tag = plain(rows)
    assert got(whole) == want
    first = {}
    for r in rows:
        for p, t in enumerate(r[2] or []):
            first[t] = min(first.get(t, (r[0], p)), (r[0], p))
    best = sorted(tag, key=lambda t: (-tag[t], first[t], t))[:3]
    assert [(r.value, r.n) for r in tallies.top(whole, "tag", 3).collect()] == [(t, tag[t]) for t in best]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("order", ["id", "o", None])
def test_values_are_counted_without_a_sort(spark, order):
    df = spark.createDataFrame(made(3), SCHEMA)
    counted = plan(tallies.tallies(df, *measures(), order, part=F.col("city")))
    assert "HashAggregate" in counted and "Sort" not in counted


@pytest.mark.parametrize("order", ["id", "o"])
def test_parts_are_added_up_without_a_sort(spark, order):
    whole = tallies.summed(tallies.tallies(spark.createDataFrame(made(3), SCHEMA), *measures(), order))
    assert "HashAggregate" in plan(tallies.top(whole, "tag")) and "Sort" not in plan(tallies.top(whole, "tag"))


def test_first_places_of_any_whole_number(spark):
    least, most = -(1 << 63), (1 << 63) - 1
    rows = [(0, ["b", "a"]), (0, ["a", "", "b", "b"]), (most, ["c", "d"]), (least, [None, "e", "d", "e"]), (None, ["a", "f"]), (-1, ["b", "g"]), (-1, ["g", "h"]), (5, None)]
    want = {}
    for o, tags in rows:
        for p, t in enumerate(tags or []):
            if t:
                old = want.get(t)
                want[t] = old if o is None or old is not None and old <= (o, p) else (o, p)
    df = spark.createDataFrame(rows, "o long, tags array<string>").repartition(4)
    counted = tallies.tallies(df, {"tag": F.col("tags")}, order="o", part=F.col("o") % 3)
    assert counted.schema["first"].dataType.simpleString() == "struct<o:bigint,p:int>"
    for whole in (tallies.summed(counted), tallies.tallies(df, {"tag": F.col("tags")}, order="o")):
        assert {r.value: r.first and tuple(r.first) for r in whole.filter("what = 'tag'").collect()} == want


def test_new_files_are_added_once(spark, tmp_path):
    folder, path = f"{tmp_path}/in put", f"{tmp_path}/tallies"
    spark.createDataFrame(made(3), SCHEMA).repartition(3).write.parquet(folder)
    add = lambda: tallies.add_files(spark, folder, path, *measures(), "id")
    assert (add(), add()) == (3, 0)
    spark.createDataFrame(made(5), SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    # a folder that was not finished does not count
    (tmp_path / "tallies" / "add-half").mkdir()
    assert (add(), add()) == (1, 0)
    assert got(tallies.summed(tallies.parts(spark, path))) == plain(made(3) + made(5))[0]


def test_empty_table(spark):
    whole = tallies.summed(tallies.tallies(spark.createDataFrame([], SCHEMA), *measures(), "id"))
    assert got(whole) == {} and tallies.top(whole, "tag").collect() == []


def test_one_scan_for_each_table_of_a_run(spark):
    b = spark.createDataFrame([("a", "X", ["x", "y"], 1), ("b", "X", ["y", "x"], 2), ("c", "", ["z", "z"], 3), ("d", None, [], 4)], "business_id string, city string, categories array<string>, ord long")
    reviews = spark.createDataFrame([("a",), ("a",), ("",), (None,), ("b",)], "business_id string")
    photos = spark.createDataFrame([("p",), ("q",), ("r",), ("s",)], "photo_id string")
    images = spark.createDataFrame([("p", "a"), ("q", "a"), ("r", None)], "photo_id string, business_id string")
    strong = spark.createDataFrame([(" ab ", "food"), ("abcd", ""), ("  ", None), ("abc", "food")], "caption string, label string")
    medium = spark.createDataFrame([("m",)], "pair_id string")
    weak = spark.createDataFrame([("b",), ("c",), ("d",), ("q",)], "business_id string")
    found = stats.dataset_statistics(b, reviews, photos, images, strong, medium, weak)
    assert found == {
        "business_count": 4, "review_count": 5, "photo_metadata_count": 4, "city_count": 1, "valid_image_count": 3, "valid_image_ratio": 0.75, "strong_pairs": 4, "medium_pairs": 1, "weak_pairs": 4,
        "top_categories": [["x", 2], ["y", 2], ["z", 2]], "photo_label_distribution": {"food": 2}, "caption_length_stats": {"caption_count": 3, "min_chars": 2, "mean_chars": 3.0, "max_chars": 4},
        "weak_group_top_categories": [["y", 1], ["z", 1]], "businesses_with_reviews": 2, "businesses_with_valid_images": 1,
    }
    none = stats.dataset_statistics(*(df.filter("false") for df in (b, reviews, photos, images, strong, medium, weak)))
    assert none["caption_length_stats"] == {"caption_count": 0, "min_chars": None, "mean_chars": None, "max_chars": None} and none["valid_image_ratio"] == 0 and none["top_categories"] == []
