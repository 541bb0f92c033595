"""Exact top-k inner products: vectors by descending length, partial sums of rotated components.

Order. Vectors are sorted by length in ranges and packed into blocks, the longest first. Queries
are packed likewise. Waves of blocks, each several times the last, meet all queries whose k-th
score so far a vector of that length could still reach (Cauchy-Schwarz); block pairs that cannot
hold such a vector are left out before any vector moves.

Bound. All vectors are rotated by the right singular vectors of the whole table (eigenvectors of
the sum of outer products of unit vectors, summed in the tasks). The first components hold most of
the length, so their partial inner product plus the product of the two residual lengths bounds the
inner product tightly. Only pairs whose bound reaches the k-th score are scored, with the integers
themselves. Bounds are slackened by more than rounding can err; scores are integers.

Scale. Queries are a fixed share of the rows, so all pairs grow with the square of the table: no
exact search avoids this where nothing can be pruned (equal lengths, no direction preferred). Pairs
never become rows: a task holds two blocks and each query's k best. Blocks of queries are spread
over ``SPREAD`` keys. The driver holds one matrix of dimension x dimension.

Edge cases: rows with a null id, a null vector, or a null or non-finite component take no part;
shorter vectors count as padded with zeros; a query's own rows are those with its id; equal rows
with a query's id ask once, and rows with one id and different vectors ask each for themselves;
repeated candidates each count; equal scores go by smaller id; floor(64 x) and scores beyond 64 bits
saturate; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

K, EVERY, SCALE = 20, 20, 64
CELLS, QUERY_ROWS, STEP = 1 << 17, 256, 256  # numbers in a block of candidates, queries in a block, candidates scored at once
HEAD, WAVE, SPREAD = 0.7, 4, 8  # share of the squared length in the partial sum, growth of the waves, keys of a query block
BLOCKS = "pile int, block long, top double, n int, ids binary, kind string, cells binary"
FOUND = "block long, slot int, query_id long, vec_id long, score long"
_MOST = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, q (integers), norm2 of the rows that take part."""
    x = F.col("embedding")
    usable = vectors.filter("vec_id is not null").filter(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    q = usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * float(scale)).cast("long")).alias("q"))
    return q.withColumn("norm2", F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of integers as rows, padded with zeros."""
    flat, cuts = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy())
    if (cuts == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(column), dim), np.int64)
    rows = np.repeat(np.arange(len(cuts)), cuts)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(cuts) - cuts, cuts)] = flat
    return out


def rotation(q: DataFrame, dim: int, head: float = HEAD) -> tuple[np.ndarray, int]:
    """The singular vectors of all unit vectors as columns, and how many of them hold ``head`` of the squares."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column(0), dim).astype(float)
            length = np.linalg.norm(m, axis=1, keepdims=True)
            m = np.divide(m, length, out=np.zeros_like(m), where=length > 0)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    sums = q.select("q").mapInArrow(outer, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    gram = np.zeros((dim, dim))
    for i, j, x in sums.collect():  # dim x dim, whatever the input
        gram[i, j] = x
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    held = np.cumsum(np.maximum(values[::-1], 0))
    cut = int(np.searchsorted(held, head * held[-1])) + 1 if held[-1] > 0 else 1
    return np.ascontiguousarray(vectors[:, ::-1]), min(cut, dim)


def packed(q: DataFrame, dim: int, rows: int, piles: int) -> DataFrame:
    """Blocks of at most ``rows`` vectors by descending length: pile (0 holds the longest), block, top (largest length), n, ids, kind and cells (integers)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, cells, tops, pile, made = [], [], [], None, 0

        def block() -> pa.RecordBatch:
            m = np.concatenate(cells)
            kind = np.result_type(np.min_scalar_type(int(m.min(initial=0))), np.min_scalar_type(-int(m.max(initial=0)) - 1))
            kind = kind if kind.kind == "i" else np.dtype(np.int64)
            row = {"pile": pile, "block": (pile << 32) + made, "top": max(tops) ** 0.5, "n": len(m), "ids": np.concatenate(ids).astype(np.int64).tobytes(), "kind": kind.str, "cells": m.astype(kind).tobytes()}
            return pa.RecordBatch.from_pylist([row], pa.schema([("pile", pa.int32()), ("block", pa.int64()), ("top", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("kind", pa.string()), ("cells", pa.binary())]))

        have = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows - have)
                at, have = at + part.num_rows, have + part.num_rows
                pile = part.column(0)[0].as_py()
                ids.append(part.column(1).to_numpy())
                cells.append(_matrix(part.column(2), dim))
                tops.append(part.column(3)[0].as_py())
                if have == rows:
                    yield block()
                    ids, cells, tops, have, made = [], [], [], 0, made + 1
        if have:
            yield block()

    spread = q.repartitionByRange(piles, F.desc("norm2"), "vec_id").sortWithinPartitions(F.desc("norm2"), "vec_id")
    return spread.select(F.spark_partition_id().alias("pile"), "vec_id", "q", "norm2").mapInArrow(pack, BLOCKS)


class _Side:
    """The vectors of a block with their lengths, partial and residual parts."""

    def __init__(self, ids: bytes, kind: str, cells: bytes, rotation: np.ndarray, cut: int) -> None:
        self.ids = np.frombuffer(ids, np.int64)
        self.whole = np.frombuffer(cells, np.dtype(kind)).reshape(len(self.ids), -1).astype(np.int64)
        self.real = self.whole.astype(float)
        self.length = np.linalg.norm(self.real, axis=1)
        self.head = self.real @ rotation[:, :cut]
        self.rest = np.sqrt(np.maximum(self.length**2 - (self.head**2).sum(axis=1), 0) + 1e-9 * self.length**2)


class _Best:
    """The k best of each query of a block, and the score and id that a further one must beat."""

    def __init__(self, queries: _Side, k: int, floors: list | None) -> None:
        self.q, self.k, n = queries, k, len(queries.ids)
        self.floor, self.floor_id = np.full(n, -_MOST - 1), np.full(n, _MOST)
        self.open = np.ones(n, bool)  # fewer than k scores so far
        for f in floors or ():
            self.floor[f["slot"]], self.floor_id[f["slot"]], self.open[f["slot"]] = f["score"], f["vec_id"], False
        self.slot, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def see(self, c: _Side) -> None:
        q = self.q
        for at in range(0, len(c.ids), STEP):
            part = slice(at, at + STEP)
            most = q.length * c.length[at]
            slack = 0.25 + 1e-9 * most
            live = np.flatnonzero(self.open | (most + slack >= self.floor))
            if not len(live):
                return  # what follows is no longer
            bound = q.head[live] @ c.head[part].T + np.outer(q.rest[live], c.rest[part])
            i, j = np.nonzero(self.open[live, None] | (bound + slack[live, None] >= self.floor[live, None]))
            i, j = live[i], j + at
            other = q.ids[i] != c.ids[j]
            i, j = i[other], j[other]
            if len(i):
                self.merge(i, c.ids[j], self.scores(c, part, i, j))

    def scores(self, c: _Side, part: slice, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.q.length[i].max() * c.length[j].max() >= 2.0**52:
            return np.array([max(-_MOST - 1, min(_MOST, sum(int(a) * int(b) for a, b in zip(self.q.whole[x], c.whole[y], strict=True)))) for x, y in zip(i, j, strict=True)], np.int64)
        if len(i) * 8 > len(self.q.ids) * (min(part.stop, len(c.ids)) - part.start):
            return (self.q.real @ c.real[part].T)[i, j - part.start].astype(np.int64)
        return np.einsum("ij,ij->i", self.q.real[i], c.real[j]).astype(np.int64)

    def merge(self, slot: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        good = self.open[slot] | (score > self.floor[slot]) | ((score == self.floor[slot]) & (ids < self.floor_id[slot]))
        if not good.any():
            return
        slot, ids, score = (np.concatenate([a, b[good]]) for a, b in ((self.slot, slot), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, ~score, slot))
        slot, ids, score = slot[order], ids[order], score[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        last = rank == self.k - 1
        s, better = slot[last], (score[last], ids[last])
        raised = self.open[s] | (better[0] > self.floor[s]) | ((better[0] == self.floor[s]) & (better[1] < self.floor_id[s]))
        self.floor[s[raised]], self.floor_id[s[raised]] = better[0][raised], better[1][raised]
        self.open[s] = False
        keep = rank < self.k
        self.slot, self.id, self.score = slot[keep], ids[keep], score[keep]

    def rows(self, block: int) -> pa.RecordBatch:
        n = len(self.slot)
        return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array(self.slot, pa.int32()), pa.array(self.q.ids[self.slot], pa.int64()), pa.array(self.id), pa.array(self.score)], ["block", "slot", "query_id", "vec_id", "score"])


def _scored(turn: np.ndarray, cut: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, block = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(n)[i] for n, name in enumerate(batch.schema.names)}
                if best is None or r["block"].as_py() != block:
                    if best is not None:
                        yield best.rows(block)
                    block = r["block"].as_py()
                    best = _Best(_Side(*(r[x].as_py() for x in ("ids", "kind", "cells")), turn, cut), k, r["floors"].as_py())
                best.see(_Side(*(r[x].as_py() for x in ("c_ids", "c_kind", "c_cells")), turn, cut))
        if best is not None:
            yield best.rows(block)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("block", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_inner(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, cells: int = CELLS, query_rows: int = QUERY_ROWS, piles: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest integer inner products of each vector whose id ``every`` divides."""
    spark = vectors.sparkSession
    piles = piles or int(spark.conf.get("spark.sql.shuffle.partitions"))
    q = stored(quantised(vectors, scale), "top-vectors")
    dim = max(q.agg(F.max(F.size("q"))).first()[0] or 1, 1)
    turn, cut = rotation(q, dim)
    candidates = stored(packed(q, dim, max(1, cells // dim), piles), "top-blocks")
    asked = q.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "q").agg(F.first("norm2").alias("norm2"))
    queries = stored(packed(asked, dim, query_rows, piles), "top-queries")
    renamed = candidates.select(F.col("block").alias("c_block"), F.col("ids").alias("c_ids"), F.col("kind").alias("c_kind"), F.col("cells").alias("c_cells"))
    best, begin, size = None, 0, 1
    while begin < piles:
        wave = F.col("pile").between(begin, begin + size - 1)
        if best is None:
            floors = queries.select("block", F.lit(None).cast("array<struct<slot:int,score:long,vec_id:long>>").alias("floors"))
        else:
            kth = best.filter(F.col("rank") == k).select("block", F.struct("slot", "score", "vec_id").alias("f"))
            floors = queries.select("block").join(kth.groupBy("block").agg(F.collect_list("f").alias("floors")), "block", "left")  # at most query_rows of a block
        # the least score that every query of a block has to beat, as a share of the block's largest length
        least = F.when(F.size("floors") == F.col("n"), F.try_divide(F.array_min(F.transform("floors", lambda f: f["score"])).cast("double") - 1, F.col("top")))
        asking = queries.join(floors, "block").withColumn("least", least)
        slim = candidates.filter(wave).select(F.col("block").alias("c_block"), F.col("top").alias("c_top"), F.explode(F.sequence(F.lit(0), F.lit(piles - 1))).alias("pile"))
        pairs = slim.join(asking.select("pile", "block", "least"), "pile").filter(F.col("least").isNull() | (F.col("c_top") * (1 + 1e-9) >= F.col("least")))
        salted = pairs.select("block", "c_block", F.pmod(F.xxhash64("c_block"), F.lit(SPREAD)).alias("key"))
        near = asking.select("block", "ids", "kind", "cells", "floors", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("key"))
        met = salted.join(renamed, "c_block").join(near, ["block", "key"]).select("block", "ids", "kind", "cells", "floors", "c_ids", "c_kind", "c_cells")
        found = met.mapInArrow(_scored(turn, cut, k), FOUND)
        best = stored(_ranked(found if best is None else best.drop("rank").unionByName(found), k), "top-best")
        begin, size = begin + size, size * WAVE
    return best.select("query_id", "rank", "vec_id", "score")


def op11_top_inner_products(spark, sf_dir: str) -> DataFrame:
    return top_inner(table(spark, sf_dir, "embeddings"))


OP11_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, a.q AS query, v.vec_id, CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, q FROM v WHERE vec_id % 20 = 0) a JOIN v ON a.vec_id <> v.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id) <= 20
"""
