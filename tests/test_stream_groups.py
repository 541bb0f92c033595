"""First and last rows of a key over a stream: split files, late files, a restart."""

import json

import pytest
from pyspark.sql import functions as F

from placeloom.operators import align
from placeloom.streaming import groups

SCHEMA = "review_id string, business_id string, stars double, ord long"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", groups.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def rows_of(seed):
    """Keys with many rows, one row and a null; nulls, ties and equal rows among them."""
    out = [{"review_id": f"r{i * seed % 97}", "business_id": None if i % 13 == 0 else f"b{(i * i + seed) % 5}", "stars": None if i % 4 == 0 else i % 3 + 0.5, "ord": (i * 37 + seed * 11) % 50} for i in range(60)]
    return [*out, {"review_id": "only", "business_id": f"once{seed}", "stars": None, "ord": seed}, *out[-2:]]


def put(folder, name, rows):
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def listed(df):
    return sorted((tuple(r[c] for c in SCHEMA_NAMES) for r in df.collect()), key=repr)


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def run(spark, folder, tmp_path, make, name):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    q = groups.write_updates(make(stream), f"{tmp_path}/{name}", f"{tmp_path}/{name}-checkpoint")
    assert q.awaitTermination(300)
    return groups.latest(spark, f"{tmp_path}/{name}", "business_id")


def plain_first(rows, n):
    by = {}
    for r in rows:
        if r["business_id"] is not None:
            by.setdefault(r["business_id"], []).append(tuple(r[c] for c in SCHEMA_NAMES))
    place = lambda r: (r[3], r[0], (r[2] is not None, r[2] or 0))
    return sorted((r for rs in by.values() for r in sorted(rs, key=place)[:n]), key=repr)


def test_first_rows_equal_the_batch_result_after_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "a.json", rows_of(1))
    put(folder, "b.json", rows_of(2))
    first = lambda s: groups.first_rows(s, "business_id", 4, "ord")
    got = run(spark, folder, tmp_path, first, "first")
    assert listed(got) == plain_first(rows_of(1) + rows_of(2), 4)
    # a new query goes on from the checkpoint; a late file holds rows that come before what was kept
    put(folder, "c.json", [r | {"ord": r["ord"] - 100} for r in rows_of(3)[::3]])
    late = listed(run(spark, folder, tmp_path, first, "first"))
    everything = spark.read.schema(SCHEMA).json(str(folder))
    assert late == plain_first([r.asDict() for r in everything.collect()], 4)
    batch = align.first_of_each(everything.filter("business_id is not null"), "business_id", 4)
    counted = lambda rows: sorted((r[1], r[3]) for r in rows)
    assert counted(late) == counted(listed(batch.select(*SCHEMA_NAMES)))
    # folded updates say the same
    groups.fold(spark, f"{tmp_path}/first", "business_id", f"{tmp_path}/folded")
    assert listed(groups.latest(spark, f"{tmp_path}/folded", "business_id")) == late


def test_last_rows_equal_the_batch_result(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [r | {"ord": i} for i, r in enumerate(rows_of(1) + rows_of(2))]
    put(folder, "a.json", rows[40:])
    put(folder, "b.json", rows[:40])
    got = run(spark, folder, tmp_path, lambda s: groups.last_rows(s, "business_id", "ord"), "last")
    want = align.last_of_each(spark.read.schema(SCHEMA).json(str(folder)), "business_id")
    assert listed(got) == listed(want.select(*SCHEMA_NAMES))
    assert {r[1] for r in listed(got)} == {r["business_id"] for r in rows} - {None}


def test_a_batch_that_is_run_again_replaces_its_rows(spark, tmp_path):
    put_again = spark.createDataFrame([("b", [("r", 1.0, 1)])], "business_id string, rows array<struct<review_id:string,stars:double,ord:long>>")
    for number, df in ((0, put_again), (0, put_again), (10, put_again.withColumn("rows", F.transform("rows", lambda r: r.withField("ord", F.lit(7).cast("long"))))), (9, put_again)):
        df.write.mode("overwrite").parquet(f"{tmp_path}/u/batch={number}")
    assert [r.ord for r in groups.latest(spark, f"{tmp_path}/u", "business_id").collect()] == [7]


def test_a_timer_gives_a_key_once_it_is_due(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "a.json", rows_of(1))
    put(folder, "b.json", rows_of(2))
    stream = spark.readStream.schema(SCHEMA).json(str(folder))
    q = groups.write_updates(groups.first_rows(stream, "business_id", 3, "ord", quiet_ms=1000), f"{tmp_path}/out", f"{tmp_path}/cp", processingTime="1 second")
    want, got = plain_first(rows_of(1) + rows_of(2), 3), []
    try:
        for _ in range(60):
            q.awaitTermination(1)
            if list((tmp_path / "out").glob("batch=*/*.parquet")):
                got = listed(groups.latest(spark, f"{tmp_path}/out", "business_id"))
            if got == want:
                break
    finally:
        q.stop()
    assert got == want
