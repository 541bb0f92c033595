"""First rows and last rows of each key over a stream.

``first_rows`` keeps the first ``n`` rows of a key, by an order column, in a list state that never
holds more than ``n`` rows. A key is given out when its list changes, or, with ``quiet_ms``, once
by a timer that runs from its first change on. ``last_rows`` is a streaming aggregation in the JVM.

Both give updates: a later row of a key replaces an earlier one. ``write_updates`` writes those of
a micro-batch to a folder of its number, so that a batch that is run again replaces what it wrote;
``latest`` reads the rows that hold now.

Edge cases: null keys are left out; a null order comes first; ties go by the other columns' values;
equal rows count one by one; ``n=0`` gives nothing; columns may have any name but ``rows``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import nsmallest

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rank(value) -> tuple:
    """Nulls first, values of one type by size, nested ones field by field."""
    if isinstance(value, (tuple, list)):
        return (1, tuple(map(_rank, value)))
    if isinstance(value, dict):
        return (1, json.dumps(value, sort_keys=True, default=str))
    return (0, 0) if value is None else (1, value)


class _FirstRows(StatefulProcessor):
    def __init__(self, n: int, key: T.StructField, rest: T.StructType, order: str, quiet_ms: int) -> None:
        self.n, self.key, self.rest, self.quiet_ms = n, key, rest, quiet_ms
        self.at = rest.names.index(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", self.rest)

    def _place(self, row: tuple) -> tuple:
        return _rank(row[self.at]), _rank(row)

    def _given(self, key, rows: list[tuple]) -> Row:
        return Row(self.key.name, "rows")(key[0], [Row(*self.rest.names)(*r) for r in rows])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        before = [tuple(r) for r in self.kept.get()]
        names = self.rest.names
        after = nsmallest(self.n, [*before, *nsmallest(self.n, (tuple(r[c] for c in names) for r in rows), self._place)], self._place)
        if after == before:
            return
        self.kept.put(after)
        if not self.quiet_ms:
            yield self._given(key, after)
        elif not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield self._given(key, [tuple(r) for r in self.kept.get()])


def first_rows(stream: DataFrame, key: str, n: int, order: str, quiet_ms: int = 0) -> DataFrame:
    """(key, rows): the first ``n`` rows of each key so far, in order, whenever they change. Needs the RocksDB state store."""
    fields = stream.schema
    rest = T.StructType([f for f in fields if f.name != key])
    out = T.StructType([fields[key], T.StructField("rows", T.ArrayType(rest))])
    processor = _FirstRows(n, fields[key], rest, order, quiet_ms)
    named = stream.filter(F.col(key).isNotNull())
    return named.groupBy(key).transformWithState(processor, out, "update", "processingTime" if quiet_ms else "none")


def last_rows(stream: DataFrame, key: str, order: str) -> DataFrame:
    """(key, rows): the last row of each key so far, as an array of one row."""
    rest = [c for c in stream.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(order, *rest))
    return stream.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array(last).alias("rows"))


def write_updates(updates: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Updates to Parquet, a folder for each micro-batch. ``trigger`` is the query's; by default it
    reads what is there and ends."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows that hold now: those of each key's last update."""
    updates = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    last = updates.groupBy(key).agg(F.max_by("rows", F.col("batch").cast("long")).alias("rows"))
    return last.select(key, F.inline("rows"))


def fold(spark: SparkSession, path: str, key: str, into: str) -> None:
    """Writes the rows that hold now to another folder as batch -1, to which a stream's later updates may be added."""
    updates = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    updates.groupBy(key).agg(F.max_by("rows", F.col("batch").cast("long")).alias("rows")).write.mode("overwrite").parquet(f"{into}/batch=-1")
