"""Reviews as a stream (an extension): the batch filter on a file source.

``filtered`` is stateless and appends. ``stats_updates`` keeps counts per business. First and last
rows of a key are in ``groups``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import parse


def read_reviews(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def filtered(stream: DataFrame, min_length: int = 20, reject_symbols: bool = True) -> DataFrame:
    return parse.with_reason(stream, min_length, reject_symbols)


def write_valid(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Valid reviews to Parquet; runs until the files that are there are read."""
    valid = parse.valid_reviews(filtered(stream))
    return valid.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stats_updates(stream: DataFrame) -> DataFrame:
    """Running statistics per business, for update or complete mode."""
    return parse.review_stats(parse.valid_reviews(filtered(stream)))
