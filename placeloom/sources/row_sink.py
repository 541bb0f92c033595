"""A sink for rows with a two-phase commit: tasks write files, the driver names them in one manifest.

A task writes its rows to a file of its own, under a name that no other attempt has. When all tasks
are done, the driver writes a new manifest that lists the files, in one rename. Readers read what the
manifest lists, so rows of failed, repeated or abandoned tasks are never seen, and a reader sees all
of a job or nothing. Files of tasks that are killed after a job was given up may stay, unread. The manifest also says which format was asked for, which was written, and why
it is another one: CSV is written if this installation cannot write the Parquet that was asked for.

``spark.dataSource.register(RowSink)`` makes it a format, ``placeloom_rows``, for ``df.write``
(options: path, format, compression; modes append and overwrite). ``write_rows`` does all of it.

Edge cases: a job without rows commits its schema; appended rows must have the table's columns, and
take its format; a table without a manifest is an error for readers. Two jobs that append at the
same time are not supported: the later manifest wins.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from . import tables
from .archive_tables import created, opened, removed, removed_folder

NAME, MANIFEST = "placeloom_rows", "_manifest.json"


def manifest(path: str) -> dict | None:
    """What was last committed under a path."""
    try:
        with opened(f"{path.rstrip('/')}/{MANIFEST}") as file:
            return json.loads(file.read())
    except FileNotFoundError:
        return None


def parquet_fault(compression: str) -> str | None:
    """Why Parquet files of a compression cannot be written here, or None."""
    try:
        import pyarrow.parquet as pq

        pq.write_table(pa.table({"x": pa.array([1])}), io.BytesIO(), compression=compression)
    except Exception as why:
        return f"Parquet with {compression} cannot be written: {why}"
    return None


@dataclass
class Part(WriterCommitMessage):
    file: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, path: str, fmt: str, compression: str, overwrite: bool) -> None:
        if fmt not in ("parquet", "csv"):
            raise ValueError(f"unknown format: {fmt}")
        self.schema, self.path, self.compression, self.job = schema.json(), path.rstrip("/"), compression, uuid.uuid4().hex
        self.before = None if overwrite else manifest(path)
        self.old = manifest(path) if overwrite else None
        if self.before is not None:
            if [(f["name"], f["type"]) for f in self.before["schema"]["fields"]] != [(f["name"], f["type"]) for f in json.loads(self.schema)["fields"]]:
                raise ValueError(f"columns differ from those under {path}")
            self.error, self.actual, self.asked = self.before["error"], self.before["actual_format"], self.before["requested_format"]
        else:
            self.error = parquet_fault(compression) if fmt == "parquet" else None
            self.actual, self.asked = "csv_fallback" if self.error else fmt, fmt

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        kind = "parquet" if self.actual == "parquet" else "csv"
        name, rows, out = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.{kind}", 0, None
        with created(f"{self.path}/{self.job}/{name}") as file:
            for batch in iterator:
                out = out or (_ParquetFile(file, batch.schema, self.compression) if kind == "parquet" else _CsvFile(file, batch.schema))
                out.add(batch)
                rows += batch.num_rows
            if out is not None:
                out.close()
        if not rows:
            removed(f"{self.path}/{self.job}/{name}")
        return Part(f"{self.job}/{name}", rows)

    def commit(self, messages: list[Part | None]) -> None:
        new = [{"file": m.file, "rows": m.rows} for m in messages if m is not None and m.rows]
        files = [*(self.before["files"] if self.before else []), *new]
        done = {"schema": json.loads(self.schema), "requested_format": self.asked, "actual_format": self.actual, "error": self.error, "rows": sum(f["rows"] for f in files), "files": files}
        with created(f"{self.path}/{MANIFEST}") as out:
            out.write(json.dumps(done).encode())
        for f in self.old["files"] if self.old else []:
            removed(f"{self.path}/{f['file']}")

    def abort(self, messages: list[Part | None]) -> None:
        removed_folder(f"{self.path}/{self.job}")  # with what killed tasks have begun


class _ParquetFile:
    def __init__(self, file, schema: pa.Schema, compression: str) -> None:
        import pyarrow.parquet as pq

        self.writer = pq.ParquetWriter(file, schema, compression=compression)

    def add(self, batch: pa.RecordBatch) -> None:
        self.writer.write_batch(batch)

    def close(self) -> None:
        self.writer.close()


class _CsvFile:
    """As Spark reads it: nested values as JSON, binary as hex, null as nothing, an empty text in quotes."""

    def __init__(self, file, schema: pa.Schema) -> None:
        self.text, self.nested = io.TextIOWrapper(file, "utf-8", newline="", write_through=True), [pa.types.is_nested(f.type) for f in schema]
        self.maps = [pa.types.is_map(f.type) for f in schema]
        self.out = csv.writer(self.text, quoting=csv.QUOTE_NOTNULL, lineterminator="\n")
        self.out.writerow(schema.names)

    def add(self, batch: pa.RecordBatch) -> None:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            self.out.writerow([self._cell(x, n, m) for x, n, m in zip(row, self.nested, self.maps, strict=True)])

    @staticmethod
    def _cell(x, nested: bool, is_map: bool):
        if x is None:
            return None
        if nested:
            return json.dumps(dict(x) if is_map else x, ensure_ascii=False, default=str)
        return x.hex().upper() if isinstance(x, bytes) else str(x).lower() if isinstance(x, bool) else x

    def close(self) -> None:
        self.text.detach()


class RowSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        o = self.options
        return _Writer(schema, o["path"], o.get("format", "parquet"), o.get("compression", "zstd"), overwrite)


def write_rows(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", compression: str = "zstd") -> dict:
    """Writes and commits; what ``tables.write_table`` returns for a table, for the whole of what is under ``path``."""
    df.sparkSession.dataSource.register(RowSink)
    df.write.format(NAME).mode(mode).options(path=path, format=fmt, compression=compression).save()
    done = manifest(path)
    return {"path": path} | {k: done[k] for k in ("rows", "requested_format", "actual_format", "error")}


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """The committed rows under a path."""
    done = manifest(path)
    if done is None:
        raise FileNotFoundError(f"nothing was committed under {path}")
    schema, files = T.StructType.fromJson(done["schema"]), [f"{path.rstrip('/')}/{f['file']}" for f in done["files"]]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*files) if done["actual_format"] == "parquet" else tables.csv_files(spark, files, schema)
