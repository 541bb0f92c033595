"""Image files: whether they can be read, and their size.

With Pillow installed an image is fully decoded. Without it the structure is walked: JPEG markers
to the end marker, PNG chunks with their checksums and the inflated data; that finds truncated
and corrupt files as well.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables

CHECK = T.StructType([T.StructField("image_valid", T.BooleanType()), T.StructField("image_width", T.LongType()), T.StructField("image_height", T.LongType()), T.StructField("validation_error", T.StringType())])


def _jpeg(data: bytes) -> tuple[int, int]:
    at, size = 2, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        length = int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            size = (width, height)
        if marker == 0xDA:
            if data.rstrip(b"\0")[-2:] != b"\xff\xd9":
                raise ValueError("truncated")
            break
        at += 2 + length
    if not size or not all(size):
        raise ValueError("no frame")
    return size


def _png(data: bytes) -> tuple[int, int]:
    at, size, packed = 8, None, b""
    while at + 12 <= len(data):
        length, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + length]
        if zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + length : at + 12 + length], "big"):
            raise ValueError("a chunk fails its checksum")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        packed += body if kind == b"IDAT" else b""
        at += 12 + length
        if kind == b"IEND":
            zlib.decompress(packed)
            if size and all(size):
                return size
    raise ValueError("truncated")


def image_size(data: bytes) -> tuple[int, int]:
    """Width and height of an image that can be read whole, or ValueError."""
    try:
        from PIL import Image
    except ImportError:
        if data[:2] == b"\xff\xd8":
            return _jpeg(data)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        raise ValueError("neither JPEG nor PNG") from None
    try:
        with Image.open(io.BytesIO(data)) as image:
            image.load()
            return image.size
    except Exception as why:
        raise ValueError(str(why)) from why


@F.pandas_udf(CHECK)
def _checked(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in contents:
        rows = []
        for data in part:
            try:
                rows.append((True, *image_size(bytes(data)), None) if data is not None else (False, None, None, "missing"))
            except (ValueError, struct.error, zlib.error, IndexError) as why:
                rows.append((False, None, None, f"corrupted: {why}"))
        yield pd.DataFrame(rows, columns=["image_valid", "image_width", "image_height", "validation_error"]).astype({"image_width": "Int64", "image_height": "Int64"})


def png_bytes(width: int) -> bytes:
    """A grey PNG image of one row."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (width + 1))) + chunk(b"IEND", b"")


@F.pandas_udf(T.BinaryType())
def blank_png(width: pd.Series) -> pd.Series:
    return width.map(png_bytes)


def image_index(photos: DataFrame, root: str) -> DataFrame:
    """Photos with what their file under ``root`` is: valid with its size, missing or corrupted.

    Files are joined by their path under the root, so that each is read once by whichever task lists
    it, and files of one name in two folders are two. A null or empty path is missing.
    """
    spark: SparkSession = photos.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    checked = files.select(tables.under(spark, root, F.col("path")).alias("_name"), _checked("content").alias("c"))
    joined = photos.withColumn("_name", tables.under(spark, root, F.coalesce("image_path", F.lit("")))).join(checked, "_name", "left")
    ok = F.coalesce(F.col("c.image_valid"), F.lit(False))
    order = [c for c in photos.columns if c == "ord"]
    return joined.select("photo_id", "business_id", "image_path", ok.alias("image_valid"), "c.image_width", "c.image_height", F.when(F.col("c").isNull(), "missing").otherwise(F.col("c.validation_error")).alias("validation_error"), *order)


def image_counts(index: DataFrame) -> DataFrame:
    """One row: total, valid, missing and corrupted."""
    e = F.col("validation_error")
    return index.agg(F.count(F.lit(1)).alias("total_images"), F.count_if("image_valid").alias("valid_images"), F.count_if(e == "missing").alias("missing_images"), F.count_if(e.startswith("corrupted")).alias("corrupted_images"))
