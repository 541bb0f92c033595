"""A model asked by tasks: bounded requests in flight, retries, and answers that survive a lost task.

Requests with the same payload are one request, keyed by its SHA-256. Keys are dealt into buckets; a
task works through its buckets, with at most ``in_flight`` requests under way, and writes answers to
the bucket's folder as they come, ``flush`` at a time, each file complete or not there. A task that
starts on a bucket first reads what the folder has: a repeated task, or a later run with the same
store, goes on where the last one stopped, and no written answer is asked for again. At most the
answers since the last file are lost with an executor. (Speculative copies of a task may ask twice.)

A request is tried ``attempts`` times, with growing pauses; a refusal of the request itself (HTTP 4xx
but 408 and 429) is not tried again. What still fails is an error in the result and is not stored, so
that a later run asks again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import modelout as M
from ..sources.archive_tables import created, listed, opened

Ask = Callable[[dict], str]
ANSWER = "key string, content string, error string, tries int"
_ARROW = pa.schema([("key", pa.string()), ("content", pa.string()), ("error", pa.string()), ("tries", pa.int32())])


def tried(ask: Ask, payload: str, attempts: int, pause: float) -> tuple[str | None, str | None, int]:
    """content, error and tries of one request."""
    for n in range(1, attempts + 1):
        try:
            return ask(json.loads(payload)), None, n
        except Exception as why:  # whatever goes wrong there is an error of this request alone
            error, code = str(why) or type(why).__name__, getattr(why, "code", None)
            if n == attempts or isinstance(code, int) and 400 <= code < 500 and code not in (408, 429):
                return None, error, n
            time.sleep(min(pause * 2 ** (n - 1), 30))
    raise ValueError("attempts must be at least 1")


def _stored(folder: str) -> Iterator[dict]:
    for path in listed(folder, ".json"):
        with opened(path) as file:
            yield from map(json.loads, file.read().decode().splitlines())


def answers(payloads: DataFrame, ask: Ask, store: str, in_flight: int = 8, attempts: int = 4, pause: float = 0.5, flush: int = 20, buckets: int | None = None) -> DataFrame:
    """key, content, error, tries: one row for each different ``payload`` (JSON text; null asks nothing).

    ``store`` is a folder that all workers see. The number of buckets must stay the same for a store.
    """
    buckets = buckets or 4 * payloads.sparkSession.sparkContext.defaultParallelism
    key = F.sha2(F.col("payload"), 256)
    one = payloads.filter("payload is not null").select(key.alias("key"), "payload").dropDuplicates(["key"]).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    root = f"{store.rstrip('/')}/{buckets}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(in_flight) as pool:
            bucket, have = None, {}
            for batch in batches:
                asked, done = {}, []
                for k, payload, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if b != bucket:
                        yield from _finish(asked, done, f"{root}/{bucket}", flush)
                        bucket, have = b, {r["key"]: r for r in _stored(f"{root}/{b}")}
                    if k in have:
                        done.append(have[k])
                        continue
                    while len(asked) >= in_flight:
                        yield from _take(asked, done, f"{root}/{bucket}", flush)
                    asked[pool.submit(tried, ask, payload, attempts, pause)] = k
                yield from _finish(asked, done, f"{root}/{bucket}", flush)

    return one.repartition(buckets, "bucket").sortWithinPartitions("bucket", "key").select("key", "payload", "bucket").mapInArrow(run, ANSWER)


def _take(asked: dict, done: list[dict], folder: str, flush: int) -> Iterator[pa.RecordBatch]:
    """Waits for at least one answer; writes and gives out what is there once it is enough."""
    for future in wait(asked, return_when=FIRST_COMPLETED).done:
        content, error, tries = future.result()
        done.append({"key": asked.pop(future), "content": content, "error": error, "tries": tries, "new": True})
    if len(done) >= flush:
        yield from _written(done, folder)


def _finish(asked: dict, done: list[dict], folder: str, flush: int) -> Iterator[pa.RecordBatch]:
    while asked:
        yield from _take(asked, done, folder, flush)
    yield from _written(done, folder)


def _written(done: list[dict], folder: str) -> Iterator[pa.RecordBatch]:
    new = [{k: r[k] for k in _ARROW.names} for r in done if r.get("new") and r["error"] is None]
    if new:
        with created(f"{folder}/{uuid.uuid4().hex}.json") as out:
            out.write("".join(json.dumps(r) + "\n" for r in new).encode())
    if done:
        yield pa.RecordBatch.from_pylist([{k: r[k] for k in _ARROW.names} for r in done], _ARROW)
        done.clear()


def understood(requests: DataFrame, ask: Ask, store: str, model: str = "unset", **how) -> DataFrame:
    """``requests`` (image_urls, user_text, version and more) with ``answer``, the stable shape of what the model says.

    Where the model fails, the answer is the one without a model, and raw_model_output says why.
    """
    row = requests.select(F.struct(*[F.col(f"`{c}`") for c in requests.columns]).alias("row"))  # columns of any name stay as they are
    urls = F.coalesce("row.image_urls", F.array().cast("array<string>"))
    payload = M.chat_payload(F.lit(model), M.prompt(F.col("row.version")), F.col("row.user_text"), urls)
    said = answers(row.select(payload.alias("payload")), ask, store, **how)
    joined = row.withColumn("key", F.sha2(payload, 256)).join(said, "key", "left").withColumn("parsed", M.parsed_responses("content"))
    alone = M.answer_without_model(urls, F.col("row.user_text"))
    failed = F.struct(alone["image_summary"], alone["structured_info"], alone["confidence"], F.concat(F.lit("vLLM request failed; fallback used: "), "error").alias("raw_model_output"))
    return joined.select("row.*", F.when(F.col("error").isNull(), F.col("parsed")).otherwise(failed.cast(M.RESPONSE)).alias("answer"))
