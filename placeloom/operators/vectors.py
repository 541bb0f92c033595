"""Vector retrieval over a catalog: an inverted file of cells with exact scores, and the fusion with keywords.

Index. Spherical k-means (Spark ML) places the cells; it is fitted on at most ``sample`` vectors,
chosen by the hash of their ids, and every vector is then filed in its nearest cell. The cells'
vectors are packed into blocks by ranges of (cell, id), so that a cell of any size is many blocks.

Search. A query reads the blocks of its ``probes`` nearest cells. Queries of one cell are packed as
well; a task multiplies a block of queries with a block of vectors and keeps each query's best, so
that pairs never become rows. Scores are exact cosines; with as many probes as cells so is the
result. A query that reads all cells is not filed in each: blocks of queries meet all blocks of vectors.
How many probes a recall needs depends on the data: ``probes_for`` measures it on some queries.

Edge cases: null ids, null or empty vectors, vectors with null or non-finite components and those of
another length than most are not filed and ask nothing; a zero vector has cosine 0 with all; equal
scores go by smaller id; repeated items each count; an empty catalog gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored

SAMPLE, ITEM_ROWS, QUERY_ROWS, CONSTANT = 50_000, 2048, 256, 60
#: Rows that a task files at once; bytes of all query blocks up to which they are broadcast.
FILED_ROWS, BROADCAST_BYTES = 20_000, 64 << 20
BLOCK = "cell int, ids binary, cells binary"
FOUND = "query_id long, item_id long, score double, cell int"


def usable(df: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """id and unit vector v of the rows that can be compared."""
    x = F.col(vector)
    fit = df.filter(F.col(key).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    fit = fit.select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: c.cast("double")).alias("x"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c))
    return fit.withColumn("length", length).select("id", F.when(F.col("length") > 0, F.transform("x", lambda c: c / F.col("length"))).otherwise(F.col("x")).alias("v"))


def cells_of(items: DataFrame, cells: int, sample: int = SAMPLE, seed: int = 11) -> np.ndarray:
    """The centres of the cells, one row each; no more than there are vectors in the sample."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    some = items.filter(F.aggregate("v", F.lit(0.0), lambda a, c: a + F.abs(c)) > 0).orderBy(F.xxhash64("id"), "id").limit(sample)
    some = stored(some.select(array_to_vector("v").alias("features"), "v"), "vector-sample")
    n = some.select("v").distinct().count()
    if n < 2 or cells < 2:
        one = some.first()
        return np.array([one.v if one else [1.0]], float)
    model = KMeans(k=min(cells, n), distanceMeasure="cosine", seed=seed, maxIter=10).fit(some.select("features"))
    return np.array(model.clusterCenters(), float)


def _unit(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _filed(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """cell, id, v of the ``probes`` nearest cells of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                near = np.argsort(-(_unit(part, 1) @ centres.T), axis=1, kind="stable")[:, :probes]
                step = max(1, FILED_ROWS // near.shape[1])
                for a in range(0, part.num_rows, step):
                    some, cells = part.slice(a, step), near[a : a + step]
                    take = pa.array(np.repeat(np.arange(some.num_rows), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(cells.ravel(), pa.int32()), some.column(0).take(take), some.column(1).take(take)], ["cell", "id", "v"])

    return rows.filter(F.size("v") == centres.shape[1]).select("id", "v").mapInArrow(run, "cell int, id long, v array<double>")


def _packed(filed: DataFrame, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        have, cell = 0, None

        def block() -> pa.RecordBatch:
            ids, vectors = np.concatenate([b.column(1).to_numpy() for b in held]), np.concatenate([_unit(b, 2) for b in held])
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([ids.astype(np.int64).tobytes()]), pa.array([vectors.tobytes()])], ["cell", "ids", "cells"])

        for batch in batches:
            cells = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                while a < b:
                    if held and (cells[a] != cell or have == rows):
                        yield block()
                        held, have = [], 0
                    cell = int(cells[a])
                    part = batch.slice(a, min(b - a, rows - have))
                    held.append(part)
                    a, have = a + part.num_rows, have + part.num_rows
        if held:
            yield block()

    return filed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").mapInArrow(run, BLOCK)


class Index:
    """Filed vectors (``blocks``, stored) and the centres of their cells."""

    def __init__(self, items: DataFrame, key: str, vector: str = "vector", cells: int | None = None, sample: int = SAMPLE, rows: int = ITEM_ROWS) -> None:
        own = stored(usable(items, key, vector), "vector-items")
        n = own.count()
        self.centres = cells_of(_of_one_length(own), cells or max(1, min(4096, int(n**0.5))), sample)
        self.blocks = stored(_packed(_filed(own, self.centres, 1), rows), "vector-blocks")

    def probes_for(self, queries: DataFrame, key: str, vector: str = "vector", k: int = 10, recall: float = 0.95, most: int = 256, not_itself: bool = False) -> int:
        """How many cells at most ``most`` of the queries (by the hash of their ids) must read to find ``recall`` of their ``k`` best.

        These few read all cells; the place of a found item's cell among the query's cells is the number of probes that it takes.
        """
        some = stored(usable(queries, key, vector).orderBy(F.xxhash64("id"), "id").limit(most), "vector-asked")
        vectors = {r.id: np.array(r.v) for r in some.collect() if len(r.v) == self.centres.shape[1]}
        found = self.search(some.withColumnsRenamed({"id": key, "v": vector}), key, vector, k, len(self.centres), not_itself).select("query_id", "cell").collect()
        place = {i: np.argsort(np.argsort(-(self.centres @ v), kind="stable")) for i, v in vectors.items()}
        needed = sorted(int(place[r.query_id][r.cell]) + 1 for r in found)
        return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] if needed else 1

    def search(self, queries: DataFrame, key: str, vector: str = "vector", k: int = 10, probes: int | None = None, not_itself: bool = False, rows: int = QUERY_ROWS) -> DataFrame:
        """query_id, item_id, score, cell, rank: the ``k`` items of largest cosine in the nearest ``probes`` cells (all if not given).

        With ``not_itself`` items of the query's own id are left out.
        """
        probes = min(probes or len(self.centres), len(self.centres))
        items = self.blocks.select("cell", F.col("ids").alias("item_ids"), F.col("cells").alias("item_cells"))
        if probes < len(self.centres):
            met = _packed(_filed(usable(queries, key, vector), self.centres, probes), rows).join(items, "cell")
        else:
            own = usable(queries, key, vector).filter(F.size("v") == self.centres.shape[1])
            asked = stored(_packed(own.select(F.lit(0).alias("cell"), "id", "v"), rows), "vector-queries").drop("cell")
            small = asked.count() * rows * (self.centres.shape[1] + 1) * 8 <= BROADCAST_BYTES
            met = items.crossJoin(F.broadcast(asked) if small else asked).select("cell", "ids", "cells", "item_ids", "item_cells")
        width = self.centres.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[bytes, np.ndarray] = {}  # each query's k best scores in this task so far, descending
            for batch in batches:
                for i in range(batch.num_rows):
                    q, c = (np.frombuffer(batch.column(n)[i].as_py(), np.int64) for n in (1, 3))
                    qv, cv = (np.frombuffer(batch.column(n)[i].as_py(), float).reshape(-1, width) for n in (2, 4))
                    score = np.round(qv @ cv.T, 9)
                    if not_itself:
                        score[q[:, None] == c[None, :]] = -np.inf
                    best = np.argsort(-score, axis=1, kind="stable")[:, :k]  # ids ascend in a block
                    at = np.repeat(np.arange(len(q)), best.shape[1]), best.ravel()
                    block, reached = batch.column(1)[i].as_py(), score[at].reshape(best.shape)
                    had = seen.get(block, np.full((len(q), k), -np.inf))
                    real = ((reached > -np.inf) & (reached >= had[:, -1:])).ravel()
                    seen[block] = -np.sort(-np.concatenate([had, reached], axis=1), axis=1)[:, :k]
                    yield pa.RecordBatch.from_arrays([pa.array(q[at[0]][real]), pa.array(c[at[1]][real]), pa.array(score[at][real]), pa.array([batch.column(0)[i].as_py()] * int(real.sum()), pa.int32())], ["query_id", "item_id", "score", "cell"])

        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
        return met.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def _of_one_length(rows: DataFrame) -> DataFrame:
    """Those of the length that most vectors have (the longer of equally common ones)."""
    most = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return rows.filter(F.size("v") == (most.n if most else 0))


def fused(*lists: DataFrame, k: int = 10, constant: int = CONSTANT) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query_id, item_id, rank): query_id, item_id, score, rank."""
    every = None
    for one in lists:
        part = one.select("query_id", "item_id", (1 / (F.col("rank") + constant)).alias("x"))
        every = part if every is None else every.unionByName(part)
    summed = every.groupBy("query_id", "item_id").agg(F.round(F.sum("x"), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return summed.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def hybrid_search(queries: DataFrame, items: DataFrame, index: Index, k: int = 10, probes: int | None = None) -> DataFrame:
    """Keyword and vector lists of ``k`` each, fused. ``queries`` has query_id, text, vector; ``items`` item_id, ord, text."""
    from .retrieval import search

    words = search(queries.select("query_id", "text"), items, k)
    near = index.search(queries.select("query_id", "vector"), "query_id", k=k, probes=probes)
    return fused(words, near, k=k).withColumn("retrieval_mode", F.lit("hybrid_rank_fusion"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """One number: the share of ``exact`` (query_id, item_id) that ``found`` has."""
    hit = exact.select("query_id", "item_id").join(found.select("query_id", "item_id").withColumn("hit", F.lit(1)), ["query_id", "item_id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
