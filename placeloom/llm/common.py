"""Session and storage helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only where the session names none and runs on one machine (tests) is a temporary one set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="placeloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: The tables that ``stored`` has written in this process, for ``drop_stored``.
_WRITTEN: list[str] = []


def drop_stored(spark: SparkSession) -> int:
    """Removes the tables that ``stored`` has written in this process: after a run, when its results are written elsewhere."""
    n = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The table cuts the lineage: lost executors re-read it instead of computing it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/placeloom/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


#: Bytes of a batch that a task hands to Python, and the setting that bounds them.
BATCH_BYTES, BATCH_SETTING = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` with batches of about ``BATCH_BYTES`` (one row at least), so that neither the task
    nor its Python worker holds 10,000 texts at once. Workers are kept by Spark and used in turn: what each
    has once needed stays with it, so they give back what Arrow has free after each task.

    Spark reads the bound when the plan runs, so it is set for the session, if that has none of its own.
    """
    spark = df.sparkSession
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(freed, schema)


def pieces(batches: Iterator[pa.RecordBatch], column: str, rows: int = 500) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of some batches with the values of a column, so that a task holds few Python objects at once."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            yield part, part.column(at).to_pylist()
    pa.default_memory_pool().release_unused()


class Cover:
    """The union of some spans (start, end), as disjoint spans in order."""

    def __init__(self, spans) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> int | None:
        """The number of the first of the spans that [a, b) overlaps, or None."""
        i = max(bisect_left(self.starts, a) - 1, 0)
        while i < len(self.starts) and self.starts[i] < b:
            if a < self.ends[i]:
                return i
            i += 1
        return None

    def holds(self, a: int, b: int) -> bool:
        """Whether one of the spans contains [a, b)."""
        i = self.meets(a, b)
        return i is not None and self.starts[i] <= a and b <= self.ends[i]
