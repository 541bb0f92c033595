"""Archives read by tasks give what the driver's version gives."""

import bz2
import gzip
import io
import lzma
import random
import tarfile
import zipfile
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from placeloom.sources import archive_tables as T
from placeloom.sources import archives


def tar_of(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "x"
        t.addfile(link)
    return out.getvalue()


def many_gzips(data, size=5000):
    return b"".join(gzip.compress(data[i : i + size]) for i in range(0, len(data), size)) + b"\0" * 40


@pytest.fixture(scope="module")
def case(tmp_path_factory):
    rng = random.Random(4)
    folder = tmp_path_factory.mktemp("zips")
    photos = [(f"./photos/p{i}.jpg", rng.randbytes(rng.randint(0, 3000))) for i in range(100)]
    text = "\n".join('{"business_id": "b%d"}' % i for i in range(3000)).encode()
    kinds = {"plain.tar": lambda b: b, "many.tar.gz": many_gzips, "one.tgz": gzip.compress, "x.tar.bz2": bz2.compress, "y.tar.xz": lzma.compress}
    with zipfile.ZipFile(folder / "a.zip", "w") as z:
        for k, (name, pack) in enumerate(kinds.items()):
            own = photos[20 * k : 20 * k + 20] + [("d/photos.json", b"{}")] * (k == 0) + [("__MACOSX/photos/p1.jpg", b"no"), ("._x", b"no")]
            z.writestr(name, pack(tar_of(own)), zipfile.ZIP_DEFLATED if name == "one.tgz" else zipfile.ZIP_STORED)
        z.writestr("Dataset_Documentation.pdf", b"doc" * 1000, zipfile.ZIP_DEFLATED)
        z.writestr("sub/TOS.txt", b"")
        z.writestr("__MACOSX/._tos", b"no")
        z.mkdir("empty.tar")
    with zipfile.ZipFile(folder / "b.zip", "w") as z:
        z.writestr("j.tar", tar_of([("yelp_academic_dataset_business.json", text), ("empty.json", b"")]))
    return folder, dict((n[2:], d) for n, d in photos), text


def test_same_files_as_on_the_driver(spark, case, tmp_path):
    folder, photos, _ = case
    found = T.members(T.entries(spark, str(folder))).cache()
    assert found.filter("layers = 'gzip' and origin > 0").count() > 5 and {r.layers for r in found.collect()} == {"", "gzip", "deflate", "deflate+gzip", "bzip2", "xz"}
    chosen = T.wanted(found, ("photos.json",), photos=True)
    done = T.extract(chosen, str(tmp_path / "new"))
    assert done.rdd.getNumPartitions() >= 2
    rows = done.collect()
    old = archives.extract_members(folder / "a.zip", tmp_path / "old", ("photos.json",), True)
    read = lambda top: {p.relative_to(top).as_posix(): sha256(p.read_bytes()).hexdigest() for p in top.rglob("*") if p.is_file()}
    assert len(rows) == 101 and read(tmp_path / "new") == {"photos.json": sha256(b"{}").hexdigest()} | {k: sha256(v).hexdigest() for k, v in photos.items()}
    # on the driver only the first gzip stream of a tar file is read
    assert len(old) == 83 and read(tmp_path / "old").items() <= read(tmp_path / "new").items()
    assert {r.path.removeprefix(f"{tmp_path}/new/"): r.sha256 for r in rows} == read(tmp_path / "new")
    assert {r.member: bytes(r.content) for r in T.contents(found.filter("member like 'photos/%'")).collect()} == photos


def test_many_tasks(spark, case, monkeypatch):
    found = T.members(T.entries(spark, str(case[0])))
    monkeypatch.setattr(T, "TASK_BYTES", 20_000)
    used = T.contents(found).select(F.spark_partition_id().alias("p")).distinct().count()
    assert used >= 4


def test_wanted_photos(spark, case, tmp_path):
    folder, photos, _ = case
    ids = spark.createDataFrame([("p3",), ("p45",), ("p45",), ("p99",), ("gone",), (None,)], "photo_id string")
    chosen = T.wanted(T.members(T.entries(spark, str(folder / "a.zip"))), (), photo_ids=ids)
    assert {r.target for r in chosen.collect()} == {"photos/p3.jpg", "photos/p45.jpg", "photos/p99.jpg"}
    assert {r.member: r.bytes for r in T.extract(chosen, f"file://{tmp_path}").collect()} == {k: len(photos[k]) for k in ("photos/p3.jpg", "photos/p45.jpg", "photos/p99.jpg")}
    assert (tmp_path / "photos/p45.jpg").read_bytes() == photos["photos/p45.jpg"]


def test_manifest(spark, case, tmp_path):
    folder, _, text = case
    made = T.extract_all(spark, str(folder), str(tmp_path), str(folder / "a.zip"), True)
    assert made["counts"] == {"json": 2, "documents": 2, "photos": 101}
    assert (tmp_path / "yelp_academic_dataset_business.json").read_bytes() == text and (tmp_path / "docs/TOS.txt").read_bytes() == b""


@pytest.mark.parametrize("split", [7, 100, 4096, 1 << 30])
def test_lines_by_ranges(spark, case, split):
    found = T.members(T.entries(spark, str(case[0] / "b.zip")))
    if split < 100:
        split = 997
    rows = sorted((r.at, r.line) for r in T.lines(found, split).collect())
    assert "\n".join(x for _, x in rows).encode() == case[2] and all(case[2][at:].startswith(x.encode()) for at, x in rows)


def test_line_ends_on_a_cut(spark, tmp_path):
    data = b"ab\ncd\n\nef\n\xff\n"
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("x.tar", tar_of([("x", data), ("y", b"no end")]))
    for split in (1, 2, 3, 4, 5, 50):
        rows = T.lines(T.members(T.entries(spark, str(tmp_path))), split).orderBy("member", "at").collect()
        assert [r.line for r in rows] == ["ab", "cd", "", "ef", "�", "no end"]


def test_round_trip_and_retries(spark, tmp_path):
    rows = [(f"photos/{i}.txt", bytes([i]) * (i * 500)) for i in range(40)] + [("null", None)]
    df = spark.createDataFrame(rows, "member string, content binary").repartition(3)
    for kind in (True, False):
        folder = str(tmp_path / str(kind))
        for _ in range(2):  # a second attempt replaces the files of the first
            assert sum(r.files for r in T.write_archives(df, folder, gzip=kind, stream_bytes=9000).collect()) == 41
        got = {r.member: bytes(r.content) for r in T.contents(T.members(T.entries(spark, folder))).collect()}
        assert got == {m: c or b"" for m, c in rows}


def test_bad_archives(spark, tmp_path):
    assert T.members(T.entries(spark, str(tmp_path))).count() == 0
    with zipfile.ZipFile(tmp_path / "cut.zip", "w") as z:
        z.writestr("x.tar.gz", gzip.compress(tar_of([("x", random.Random(1).randbytes(50_000))]))[:9000])
    with pytest.raises(Exception, match="ends early|unexpected end"):
        T.members(T.entries(spark, str(tmp_path))).collect()
    with pytest.raises(Exception, match="unsafe member"):
        T.extract(spark.createDataFrame([("a", "e", "../x", "", 0, 1, 0, 0, 1, "../x")], T.FOUND + ", target string"), str(tmp_path)).collect()
