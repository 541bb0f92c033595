"""Archives as tables: what is in zip files and in the tar files inside them, read in ranges by tasks.

Three steps, each a DataFrame. ``entries`` lists the zip files' own entries from their directories.
``members`` walks each tar file once: an uncompressed one from header to header without reading
contents, a compressed one as a stream. A member's row says where its bytes can be had: the range
of the archive, how it is decoded, and how far into the decoded range the member lies. A compressed
tar is decoded from the start of the gzip (bzip2, xz) stream that a member begins in; files of
several such streams give as many units of work. After that, members are chosen with filters and
joins like any rows, and ``contents``, ``extract`` and ``lines`` read only the ranges of those
chosen. ``lines`` cuts large uncompressed members into ranges of whole lines.

``contents`` makes a row of each member, so a member must fit a row; ``extract`` copies members of
any size, each to a name of its own that becomes the final one when the copy is whole, so that a
repeated task does no harm. Archives are read with Python's files or, under a scheme other than
``file``, with Arrow's file systems, from all workers.

Edge cases: resource forks, folders and links are left out; a folder without zip files gives an
empty table; a member that would leave the target folder is an error, as are encrypted entries and
compressions that are not known; of several members for one target the first counts; trailing
zeros after a compressed stream are padding.
"""

from __future__ import annotations

import bz2
import io
import lzma
import os
import shutil
import tarfile
import uuid
import zipfile
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .archives import MEMBERS, is_resource_fork, member_name

ENTRIES = "archive string, entry string, tar boolean, start long, length long, layers string, size long"
FOUND = "archive string, entry string, member string, layers string, start long, length long, origin long, offset long, size long"
BLOCK, SPLIT, TASK_BYTES = 1 << 20, 64 << 20, 128 << 20
_ZIP_LAYERS = {zipfile.ZIP_STORED: "", zipfile.ZIP_DEFLATED: "deflate", zipfile.ZIP_BZIP2: "bzip2"}
_MAGIC = ((b"\x1f\x8b", "gzip"), (b"BZh", "bzip2"), (b"\xfd7zXZ\x00", "xz"))


# ---- files


def target_path(folder: str, name: str) -> str:
    parts = [p for p in member_name(name).split("/") if p not in ("", ".")]
    if ".." in parts or not parts:
        raise ValueError(f"unsafe member: {name}")
    return "/".join([folder.rstrip("/"), *parts])


def _place(path: str):
    """None and a local path, or an Arrow file system and a path on it."""
    if path.startswith("file:"):
        return None, "/" + path[5:].lstrip("/")
    if "://" not in path:
        return None, path
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def opened(path: str):
    system, name = _place(path)
    return open(name, "rb") if system is None else system.open_input_file(name)


@contextmanager
def created(path: str):
    """A file that gets its name when it is whole."""
    system, name = _place(path)
    part = f"{name}.{uuid.uuid4().hex}.part"
    if system is None:
        os.makedirs(os.path.dirname(name), exist_ok=True)
    else:
        system.create_dir(name.rpartition("/")[0], recursive=True)
    try:
        with open(part, "wb") if system is None else system.open_output_stream(part) as out:
            yield out
    except BaseException:
        removed(f"{path}{part[len(name):]}")
        raise
    if system is None:
        os.replace(part, name)
    else:
        system.move(part, name)


def listed(folder: str, ending: str) -> list[str]:
    """The files of a folder whose name has some ending; none if there is no such folder."""
    system, name = _place(folder)
    if system is None:
        return sorted(os.path.join(name, f) for f in os.listdir(name) if f.endswith(ending)) if os.path.isdir(name) else []
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(name, allow_not_found=True))
    return sorted(f"{folder.rstrip('/')}/{f.base_name}" for f in found if f.base_name.endswith(ending))


def removed(path: str) -> None:
    """Removes a file, if it is there."""
    system, name = _place(path)
    try:
        if system is None:
            os.remove(name)
        else:
            system.delete_file(name)
    except FileNotFoundError:
        pass


def removed_folder(path: str) -> None:
    system, name = _place(path)
    if system is None:
        shutil.rmtree(name, ignore_errors=True)
    elif system.get_file_info(name).type.name == "Directory":
        system.delete_dir(name)


class Window(io.RawIOBase):
    """A range of a file as a file."""

    def __init__(self, file, start: int, length: int) -> None:
        self.file, self.start, self.length, self.at = file, start, length, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = to + (0, self.at, self.length)[whence]
        return self.at

    def readinto(self, into) -> int:
        n = max(0, min(len(into), self.length - self.at))
        self.file.seek(self.start + self.at)
        data = self.file.read(n)
        into[: len(data)] = data
        self.at += len(data)
        return len(data)


class Decoded(io.RawIOBase):
    """A compressed stream as a file. ``starts`` has where its parts begin: (decoded, encoded) positions."""

    def __init__(self, source, kind: str) -> None:
        self.source, self.kind, self.encoded, self.decoded, self.buffer = source, kind, 0, 0, b""
        self.starts, self.engine, self.data, self.over = [(0, 0)], self._new(), b"", False

    def _new(self):
        return {"deflate": lambda: zlib.decompressobj(-15), "gzip": lambda: zlib.decompressobj(31), "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}[self.kind]()

    def readable(self) -> bool:
        return True

    def _more(self) -> bytes:
        """The next decoded bytes, at most BLOCK; empty at the end."""
        while not self.over:
            if not self.data and getattr(self.engine, "needs_input", True):
                self.data = self.source.read(BLOCK) or b""
                self.encoded += len(self.data)
                if not self.data:
                    raise EOFError(f"a {self.kind} stream ends early")
            out = self.engine.decompress(self.data, BLOCK)
            self.data = self.engine.unconsumed_tail if hasattr(self.engine, "unconsumed_tail") else b""
            self.decoded += len(out)
            if self.engine.eof:
                self._next(self.engine.unused_data)
            if out:
                return out
        return b""

    def _next(self, rest: bytes) -> None:
        while True:
            rest = rest.lstrip(b"\0")
            if rest and len(rest) >= 6 or self.kind == "deflate":
                break
            more = self.source.read(BLOCK)
            if not more:
                break
            self.encoded += len(more)
            rest += more
        self.over = self.kind == "deflate" or not any(k == self.kind and rest.startswith(m) for m, k in _MAGIC)
        if not self.over:
            self.starts.append((self.decoded, self.encoded - len(rest)))
            self.engine, self.data = self._new(), rest

    def readinto(self, into) -> int:
        if not self.buffer:
            self.buffer = self._more()
        n = min(len(into), len(self.buffer))
        into[:n] = self.buffer[:n]
        self.buffer = self.buffer[n:]
        return n


def _stream(file, start: int, length: int, layers: str):
    source = io.BufferedReader(Window(file, start, length), BLOCK)
    for kind in filter(None, layers.split("+")):
        source = io.BufferedReader(Decoded(source, kind), BLOCK)
    return source


# ---- what is there


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _each(ddl: str, one: Callable[[dict], Iterable[dict]]):
    """mapInArrow: rows of ``one`` for each row, a few hundred at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out = _arrow(ddl), []
        for batch in batches:
            for row in batch.to_pylist():
                for made in one(row):
                    out.append(made)
                    if len(out) >= 500:
                        yield _rows(schema, out)
                        out = []
        if out:
            yield _rows(schema, out)

    return run


def _listed(row: dict) -> Iterator[dict]:
    with opened(row["path"]) as file, zipfile.ZipFile(file) as outer:
        for info in outer.infolist():
            if info.is_dir() or is_resource_fork(info.filename):
                continue
            if info.flag_bits & 1 or info.compress_type not in _ZIP_LAYERS:
                raise ValueError(f"{info.filename} in {row['path']} is encrypted or has an unknown compression")
            file.seek(info.header_offset + 26)  # lengths of name and extra field in the entry's own header
            name, extra = (int.from_bytes(file.read(2), "little") for _ in range(2))
            base = info.filename.replace("\\", "/").rpartition("/")[2]
            yield {"archive": row["path"], "entry": info.filename, "tar": ".tar" in base or base.endswith(".tgz"), "start": info.header_offset + 30 + name + extra, "length": info.compress_size, "layers": _ZIP_LAYERS[info.compress_type], "size": info.file_size}


def _walked(row: dict) -> Iterator[dict]:
    at = {k: row[k] for k in ("archive", "entry", "layers", "start", "length")}
    if not row["tar"]:
        yield at | {"member": member_name(row["entry"]), "origin": 0, "offset": 0, "size": row["size"]}
        return
    with opened(row["archive"]) as file:
        head = _stream(file, row["start"], row["length"], row["layers"]).read(6)
        own = next((k for m, k in _MAGIC if head.startswith(m)), "")
        at["layers"] = "+".join(filter(None, (row["layers"], own)))
        source = _stream(file, row["start"], row["length"], at["layers"])
        with tarfile.open(fileobj=source, mode="r|" if at["layers"] else "r:") as inner:
            for member in inner:
                inner.members = []  # else all headers stay
                name = member_name(member.name)
                if not member.isfile() or is_resource_fork(name):
                    continue
                if member.issparse():
                    raise ValueError(f"{name} in {row['entry']} is sparse")
                origin, start = 0, 0
                if own and not row["layers"]:
                    starts = source.raw.starts
                    origin, start = starts[bisect_right(starts, (member.offset_data, 1 << 62)) - 1]
                yield at | {"member": name, "start": row["start"] + start, "length": row["length"] - start, "origin": origin, "offset": member.offset_data, "size": member.size}


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the zip files in a folder, or of one zip file (by their directories)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path).select("path")
    return files.repartition("path").mapInArrow(_each(ENTRIES, _listed), ENTRIES)


def members(found: DataFrame) -> DataFrame:
    """The files in the tar files among ``entries``, and the other entries as they are. One task for each tar file."""
    return found.repartition(max(1, min(found.count(), 10_000))).mapInArrow(_each(FOUND, _walked), FOUND)


def wanted(found: DataFrame, names: Iterable[str] = MEMBERS, photos: bool = False, photo_ids: DataFrame | None = None) -> DataFrame:
    """Those of ``members`` with these file names, and photos (all, or those of ``photo_ids``), with their ``target``."""
    base, image = F.substring_index("member", "/", -1), F.regexp_extract("member", "photos/.*", 0)
    named = found.withColumns({"target": F.when(base.isin(list(names)), base), "image": image})
    out = named.filter("target is not null")
    if photos or photo_ids is not None:
        some = named.filter("target is null and image <> ''").withColumn("target", F.col("image"))
        if photo_ids is not None:
            some = some.join(photo_ids.select(F.concat(F.lit("photos/"), "photo_id", F.lit(".jpg")).alias("target")), "target", "left_semi").select(named.columns)
        out = out.unionByName(some)
    return _one_each(out.drop("image"))


def documents(found: DataFrame) -> DataFrame:
    """Those of ``members`` whose name speaks of documentation or terms of service, under ``docs/``."""
    base = F.substring_index("member", "/", -1)
    return _one_each(found.withColumn("target", F.concat(F.lit("docs/"), base)).filter(F.lower(base).rlike("documentation|tos")))


def _one_each(found: DataFrame) -> DataFrame:
    fields = [c for c in found.columns if c != "target"]
    first = found.groupBy("target").agg(F.min(F.struct("archive", "entry", "offset", *[c for c in fields if c not in ("archive", "entry", "offset")])).alias("x"))
    return first.select(*[F.col(f"x.{c}").alias(c) for c in fields], "target")


# ---- their bytes


def _unit() -> Column:
    """What has to be read in one go: a compressed range, or just the member."""
    return F.when(F.col("layers") == "", F.col("start") + F.col("offset")).otherwise(F.col("start"))


def _dealt(found: DataFrame) -> DataFrame:
    """Members by unit, to enough tasks for their bytes; in the order in which they lie there."""
    parts = _tasks(found, F.col("size"))
    return found.withColumn("unit", _unit()).repartition(parts, "archive", "unit").sortWithinPartitions("archive", "unit", "offset")


def _tasks(rows: DataFrame, size: Column) -> int:
    """Tasks for about TASK_BYTES each, but for all cores if there are rows enough."""
    n, total = rows.agg(F.count("*"), F.sum(size)).first()
    return max(1, min(n, max(rows.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // TASK_BYTES))))


class _Reader:
    """Ranges of archives, read forward; a stream stays open while the next member lies in it."""

    def __init__(self) -> None:
        self.path, self.file, self.unit, self.stream, self.at = None, None, None, None, 0

    def member(self, row: dict) -> Iterator[bytes]:
        if row["archive"] != self.path:
            self.close()
            self.path, self.file = row["archive"], opened(row["archive"])
        unit, skip = (row["start"], row["layers"]), row["offset"] - row["origin"]
        if unit != self.unit or not row["layers"] or skip < self.at:
            first = row["start"] if row["layers"] else row["start"] + skip
            self.stream = _stream(self.file, first, row["length"] if row["layers"] else row["size"], row["layers"])
            self.unit, self.at = unit, 0 if row["layers"] else skip
        while self.at < skip:
            self.at += len(self._take(skip - self.at))
        end = skip + row["size"]
        while self.at < end:
            block = self._take(end - self.at)
            self.at += len(block)
            yield block

    def _take(self, n: int) -> bytes:
        block = self.stream.read(min(n, BLOCK))
        if not block:
            raise EOFError(f"{self.path} ends early")
        return block

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.path, self.file, self.unit = None, None, None


def contents(found: DataFrame) -> DataFrame:
    """archive, member, content of each member. A batch holds at most a few MB or one member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, reader, out, held = _arrow("archive string, member string, content binary"), _Reader(), [], 0
        for batch in batches:
            for row in batch.to_pylist():
                out.append({"archive": row["archive"], "member": row["member"], "content": b"".join(reader.member(row))})
                held += row["size"]
                if held > 8 * BLOCK or len(out) >= 1000:
                    yield _rows(schema, out)
                    out, held = [], 0
        reader.close()
        if out:
            yield _rows(schema, out)

    return _dealt(found).mapInArrow(run, "archive string, member string, content binary")


def extract(found: DataFrame, folder: str) -> DataFrame:
    """Copies members to their ``target`` under a folder that all workers see: member, path, bytes, sha256. Lazy: an action copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                path, digest = target_path(folder, row["target"]), sha256()
                with created(path) as out:
                    for block in reader.member(row):
                        digest.update(block)
                        out.write(block)
                done.append({"member": row["member"], "path": path, "bytes": row["size"], "sha256": digest.hexdigest()})
            yield _rows(_arrow("member string, path string, bytes long, sha256 string"), done)
        reader.close()

    return _dealt(found).mapInArrow(run, "member string, path string, bytes long, sha256 string")


def lines(found: DataFrame, split: int = SPLIT) -> DataFrame:
    """archive, member, at (the byte where it begins), line: the text lines of members, in ranges of about ``split`` bytes."""
    cuts = F.when(F.col("layers") == "", F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    ranges = found.withColumn("low", F.explode(cuts)).withColumn("high", F.when(F.col("layers") == "", F.least(F.col("low") + split, F.col("size"))).otherwise(F.col("size")))

    def one(row: dict) -> Iterator[dict]:
        # a range owns the lines that begin in it; it looks one byte back to see whether one begins at its start
        low, reader = max(row["low"] - 1, 0), _Reader()
        at = row | {"offset": row["offset"] + low, "size": row["size"] - low}
        position, rest, first = low, b"", row["low"] > 0
        for block in reader.member(at):
            rest += block
            *whole, rest = rest.split(b"\n")
            for line in whole:
                begin, position = position, position + len(line) + 1
                if first:
                    first = False
                    continue
                if begin >= row["high"]:
                    return
                yield {"archive": row["archive"], "member": row["member"], "at": begin, "line": line.decode(errors="replace")}
            if position >= row["high"]:
                return
        if rest and not first and position < row["high"]:
            yield {"archive": row["archive"], "member": row["member"], "at": position, "line": rest.decode(errors="replace")}

    ddl = "archive string, member string, at long, line string"
    return ranges.repartition(_tasks(ranges, F.col("high") - F.col("low"))).mapInArrow(_each(ddl, one), ddl)


# ---- writing


class _Gzip:
    """Gzip streams of about ``size`` bytes of content each, one after the other."""

    def __init__(self, out, size: int) -> None:
        self.out, self.size, self.n, self.engine = out, size, 0, zlib.compressobj(6, zlib.DEFLATED, 31)

    def write(self, data: bytes) -> int:
        self.out.write(self.engine.compress(data))
        self.n += len(data)
        if self.n >= self.size:
            self.close()
            self.n, self.engine = 0, zlib.compressobj(6, zlib.DEFLATED, 31)
        return len(data)

    def close(self) -> None:
        self.out.write(self.engine.flush())


def write_archives(files: DataFrame, folder: str, name: str = "part", gzip: bool = False, stream_bytes: int = 4 << 20) -> DataFrame:
    """Writes (member, content) into one zip file of one tar file for each partition: path, files. Lazy: an action writes.

    A repeated task writes the same file again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        path = f"{folder.rstrip('/')}/{name}-{part:05d}.zip"
        with created(path) as file, zipfile.ZipFile(file, "w") as outer, outer.open(f"{name}-{part:05d}.tar" + ".gz" * gzip, "w", force_zip64=True) as entry:
            sink = _Gzip(entry, stream_bytes) if gzip else entry
            with tarfile.open(fileobj=sink, mode="w|") as inner:
                for batch in batches:
                    for row in batch.to_pylist():
                        info = tarfile.TarInfo(row["member"])
                        info.size = len(row["content"] or b"")
                        inner.addfile(info, io.BytesIO(row["content"] or b""))
                        n += 1
            if gzip:
                sink.close()
        yield _rows(_arrow("path string, files long"), [{"path": path, "files": n}])

    return files.select("member", "content").mapInArrow(run, "path string, files long")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes (member, content) as files under a folder: path, bytes. Lazy: an action writes."""

    def one(row: dict) -> Iterator[dict]:
        path = target_path(folder, row["member"])
        with created(path) as out:
            out.write(row["content"] or b"")
        yield {"path": path, "bytes": len(row["content"] or b"")}

    return files.select("member", "content").mapInArrow(_each("path string, bytes long", one), "path string, bytes long")


def extract_all(spark: SparkSession, json_zip: str, folder: str, photos_zip: str | None = None, photos: bool = False, photo_ids: DataFrame | None = None) -> dict:
    """Tables, documents and, if asked for, photos, copied by tasks. Returns the manifest: counts, and files by kind (photos only counted)."""
    found = members(entries(spark, json_zip)).cache()
    done = {"json": extract(wanted(found), folder), "documents": extract(documents(found.filter("member = entry")), folder)}
    files = {k: [r.asDict() for r in df.collect()] for k, df in done.items()}  # a handful of names
    counts = {k: len(v) for k, v in files.items()}
    found.unpersist()
    counts["photos"] = extract(wanted(members(entries(spark, photos_zip)), ("photos.json",), photos, photo_ids), folder).count() if photos_zip else 0
    return {"folder": folder, "counts": counts, "files": files}
