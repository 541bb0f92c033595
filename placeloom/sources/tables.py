"""Readers and writers of tables.

Order. ``ordered`` adds ``ord``, a struct that sorts like the files' order: path, then the row's
place. Parquet knows a row's index; for text the block's start and an increasing number within
the block serve.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

IMAGE_INDEX = "photo_id string, business_id string, image_path string, image_valid boolean, image_width long, image_height long, validation_error string"

BROADCAST_ROWS = 100_000
#: What ``scratch`` has named in this process, for ``drop_scratch``.
_NAMED: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share. Only on one machine, without a
    setting, is a temporary folder set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="placeloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    _NAMED.append(f"{base.rstrip('/')}/placeloom/{name}-{uuid.uuid4().hex}")
    return _NAMED[-1]


def drop_scratch(spark: SparkSession) -> int:
    """Removes what this process has written under ``scratch`` names: after a run, when its results are written elsewhere."""
    n = 0
    while _NAMED:
        fs, p = _hadoop(spark, _NAMED.pop())
        n += bool(fs.delete(p, True))
    return n


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: read twice without being made twice."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame) -> DataFrame:
    """``df``, which is stored and of a few narrow columns, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ordered(df: DataFrame, parquet: bool = True) -> DataFrame:
    row = F.col("_metadata.row_index") if parquet else F.monotonically_increasing_id()
    start = F.lit(0).cast("long") if parquet else F.col("_metadata.file_block_start")
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), start.alias("start"), row.alias("row")).alias("ord"))


def line_kind(line: Column) -> Column:
    """record (one JSON object), blank, or malformed (bad JSON, or a value that is no object).

    The line is an element of an array, once with one element after it and once with two. The array has
    two and three elements only if the line is one value and does not close the array itself, whatever
    comes after it. NaN and Infinity are numbers, as in Python's reader; duplicate keys are allowed (but in
    a line that has a tab or a return as well).
    Depth and the length of numbers and texts are bounded by Spark's reader (1000 levels, 1000 digits,
    20 million characters; beyond them a line is malformed).
    """
    # Spark's reader takes single quotes for quotes; as letters they are right in a text and wrong elsewhere
    numbers = F.regexp_replace(F.translate(line, "'", "x"), r"(?<=[:,\[\s])(-?Infinity|NaN)(?=[,\]}\s])", "0")  # in a text as well, which stays a text
    one = lambda after, n: F.coalesce(F.json_array_length(F.concat(F.lit("["), numbers, F.lit(after))) == n, F.lit(False))
    # the reader also takes control characters in a text, which are none in JSON; tabs and returns may stand between values
    strict = ~line.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]") & (~line.rlike(r"[\t\r]") | F.try_parse_json(numbers).isNotNull())
    record = strict & line.rlike(r"^[ \t\r\n]*\{") & one(",0]", 2) & one(",0,0]", 3)
    return F.when(X.strip(line) == "", "blank").when(record, "record").otherwise("malformed")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, kind, ord): each line with its kind: record, blank or malformed (bad JSON, or no object).

    A missing path gives an empty table. Kinds follow Python's JSON reader, so that duplicate keys
    and NaN are records and trailing text is not.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "line string, kind string, ord struct<file:string,start:long,row:long>")
    lines = ordered(spark.read.text(path), parquet=False)
    return lines.select(F.col("value").alias("line"), line_kind(F.col("value")).alias("kind"), "ord")


def _line_counts() -> list[Column]:
    k = F.col("kind")
    return [F.count(F.lit(1)).alias("total_lines"), F.count_if(k == "record").alias("records"), F.count_if(k == "malformed").alias("malformed_lines")]


def line_counts(lines: DataFrame) -> DataFrame:
    """One row: total_lines, records, malformed_lines."""
    return lines.agg(*_line_counts())


def counted_lines(lines: DataFrame) -> tuple[DataFrame, Observation]:
    """``lines`` whose first scan also counts them: ``get`` of the observation is the row of ``line_counts``.

    For an action that reads them once and whole: a write without a sort or a limit (a sort reads twice).
    """
    seen = Observation()
    return lines.observe(seen, *_line_counts()), seen


def json_records(lines: DataFrame, schema: str) -> DataFrame:
    """The records of ``json_lines`` under a schema, with ord."""
    return lines.filter("kind = 'record'").select(F.from_json("line", schema).alias("r"), "ord").select("r.*", "ord")


def strict_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a file that must exist and hold nothing but JSON objects and blank lines."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def under(spark: SparkSession, root: str, path: Column) -> Column:
    """A path relative to the folder ``root``, however the scheme is written; other paths stay as they are."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    plain = F.regexp_replace(F.replace(F.regexp_replace(path, r"^file:/+", "/"), F.lit("\\"), F.lit("/")), r"^\./|/(?=/)", "")
    out = plain
    for start in dict.fromkeys((re.sub("^file:/+", "/", full), re.sub(r"^file:/+", "/", root).replace("\\", "/").removeprefix("./").rstrip("/"))):
        out = F.when(F.startswith(plain, F.lit(start + "/")), F.substring(plain, len(start) + 2, 1 << 30)).otherwise(out)
    return out


def first_existing(spark: SparkSession, folder: str, names: list[str], required: bool = True) -> str | None:
    """The first of the names that is in the folder."""
    for name in names:
        if exists(spark, f"{folder}/{name}"):
            return f"{folder}/{name}"
    if required:
        raise FileNotFoundError(f"none of {names} is in {folder}")
    return None


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _put_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _hadoop(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _get_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    source = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


#: A CSV table carries its schema beside its parts, where Spark's readers do not look.
SCHEMA_FILE = "_schema.json"
#: No text is this one, so that a quoted empty text is read as a text and nothing as null.
_NO_TEXT = "\x01null\x01"
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def csv_files(spark: SparkSession, path: str | list[str], types: T.StructType, order: bool = False, written_here: bool = True) -> DataFrame:
    own = {"lineSep": "\n"} if written_here else {}  # else carriage returns in texts are lost
    flat = spark.read.options(header=True, multiLine=True, escape='"', nullValue=_NO_TEXT, **own).csv(path)
    there = [f for f in types if f.name in flat.columns]
    flat = ordered(flat, parquet=False) if order else flat
    cols = [(F.from_json(f"`{f.name}`", f.dataType) if isinstance(f.dataType, _NESTED) else F.unhex(f"`{f.name}`") if isinstance(f.dataType, T.BinaryType) else F.col(f"`{f.name}`").try_cast(f.dataType)).alias(f.name) for f in there]
    return flat.select(*cols, *["ord"] * order)


def csv_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The schema that a CSV table carries; None for tables of another format."""
    text = _get_text(spark, f"{path}/{SCHEMA_FILE}")
    return None if text is None else T.StructType.fromJson(json.loads(text))


def read_table(spark: SparkSession, path: str, schema: str | None = None, order: bool = False) -> DataFrame:
    """A Parquet table, or a CSV table under the schema that it carries, or else ``schema`` (nested columns are JSON text there).

    What a table is is told by its contents, not its name: a table that fell back to CSV is read as such.
    With ``order`` rows have ``ord``.
    """
    if not exists(spark, path):
        empty = spark.createDataFrame([], schema or T.StructType([]))
        return empty.withColumn("ord", F.lit(None).cast("struct<file:string,start:long,row:long>")) if order else empty
    own = csv_schema(spark, path)
    if own is None and not path.endswith(".csv"):
        return ordered(spark.read.parquet(path)) if order else spark.read.parquet(path)
    if own is None and schema is None:
        raise ValueError("a CSV table needs a schema")
    return csv_files(spark, path, own or T._parse_datatype_string(schema), order, own is not None)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> dict:
    """Write a table; an empty one keeps its schema. Returns path, rows, requested_format, actual_format and error.

    If Parquet of this schema cannot be written here (tried with a table without rows, so that ``df`` is
    computed once), the table is written as CSV in its place: actual_format is then csv_fallback, and
    error says why.
    """
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown format: {fmt}")
    error = _parquet_fault(df) if fmt == "parquet" else None
    done = {"path": path, "requested_format": fmt, "actual_format": "csv_fallback" if error else fmt, "error": error}
    if done["actual_format"] == "parquet":
        return done | {"rows": _written(df, lambda out: out.parquet(path))}
    nested = [f.name for f in df.schema if isinstance(f.dataType, _NESTED)]
    binary = [f.name for f in df.schema if isinstance(f.dataType, T.BinaryType)]
    flat = df.select([(F.to_json(f"`{c}`") if c in nested else F.hex(f"`{c}`") if c in binary else F.col(f"`{c}`")).alias(c) for c in df.columns])
    done["rows"] = _written(flat, lambda out: out.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path))
    _put_text(df.sparkSession, f"{path}/{SCHEMA_FILE}", df.schema.json())
    return done


def _parquet_fault(df: DataFrame) -> str | None:
    try:
        df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.parquet(scratch(df.sparkSession, "probe"))
    except Exception as why:
        return re.sub(r"\s+", " ", str(why))[:300]
    return None


def _written(df: DataFrame, write) -> int:
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite"))
    return seen.get["rows"]


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json(path: str | Path, value) -> None:
    """A small result as indented JSON text."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, ensure_ascii=False, indent=2, default=str) + "\n", encoding="utf-8")


def read_json(path: str | Path) -> dict:
    path = Path(path)
    return json.loads(path.read_text(encoding="utf-8")) if path.exists() else {}


def inspect(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Rows and columns of a Parquet table; the count reads footers only."""
    df = spark.read.parquet(path)
    return df.count(), df.columns


def is_parquet(spark: SparkSession, path: str) -> bool:
    """Whether each part of a table begins with Parquet's magic bytes; four bytes of each file are read."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return False
    files, some = fs.listFiles(top, True), False
    while files.hasNext():
        part = files.next().getPath()
        if part.getName()[:1] in ("_", "."):
            continue
        data = fs.open(part)
        try:
            some = True
            if bytes(data.read() & 255 for _ in range(4)) != b"PAR1":
                return False
        finally:
            data.close()
    return some


def photo_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-empty photo ids of a JSON-lines file of items."""
    return spark.read.schema("photo_id string").json(path).filter("photo_id is not null and photo_id <> ''").distinct()
