"""Mixing sources to target weights by pivotal dependent rounding.

Targets. Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share
``total_share`` of all words. No target exceeds ``max_copies`` times its source's words; what is
cut off is shared again by weight until no target is above its bound (water-filling).

Rounding. Every document of a source is to be taken ``target / source_size`` times. The whole
part is certain; the fraction is settled by the pivotal method: two fractions fight, words move
at random from one to the other until one of them is whole, and the one that is not fights on.
Words, not copies, are what moves: that keeps each document's expected copies and the source's
sum of words. The fights run from long to short documents, so that what is left open in the end
is short.

Reduction tree. Documents are dealt into blocks of about ``block_rows`` by a hash of id, text and a
number among rows that are equal in both, so that null or repeated ids do not meet in one block;
equal rows are counted first and numbered again in pieces of ``PIECE``. Each block leaves at most one fraction. Those are combined ``fan`` blocks at a time, level by
level, until a source has one fraction, which a last draw settles. Draws depend on the seed, the
source and the block only, so that reruns agree.

Edge cases: a null text has size 0; a null source is a source of its own; an empty table gives
an empty result; if all sizes are 0, all targets are 0; repeated rows are separate documents.
The weights need one row per source in one task; documents never meet in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

WEIGHTS, TOTAL_SHARE, MAX_COPIES = (5, 2, 1), 1.5, 2.0
BLOCK_ROWS, FAN, SEED, PIECE = 4096, 32, 20250101, 4096
WORD = r"[^\x20\x09-\x0D]+"
_EPS = 1e-9


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_copies: float = MAX_COPIES) -> DataFrame:
    """One row per source: key, source_size, n_docs, target. ``sizes`` has key, size."""
    one = sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    everything = Window.partitionBy()
    in_order = Window.orderBy("key")  # keys sort by code point, the null source last
    ranked = one.withColumns({"i": F.row_number().over(in_order) - 1, "budget": F.sum("source_size").over(everything) * F.lit(float(total_share))})
    ranked = ranked.withColumns({"w": F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod("i", F.lit(len(weights))) + 1), "bound": F.col("source_size") * F.lit(float(max_copies))})
    by_ratio = Window.orderBy(F.col("bound") / F.col("w"), "i")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.withColumns({
        "n": F.row_number().over(by_ratio),
        "level": (F.col("budget") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))),
    })
    fits = F.when(F.col("level") <= F.col("bound") / F.col("w"), F.struct("n", "level"))
    filled = filled.withColumn("first_fit", F.min(fits).over(everything))
    target = F.when(F.col("first_fit").isNull() | (F.col("n") < F.col("first_fit.n")), F.col("bound")).otherwise(F.least("bound", F.col("first_fit.level") * F.col("w")))
    return filled.select("key", "source_size", "n_docs", target.alias("target"))


def pivotal(p: np.ndarray, sizes: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Settle the fractions ``p`` in order. Returns 0/1 per entry, and the entry that is left with
    a fraction and that fraction (-1, 0.0 if none is left). Entries without words are drawn alone."""
    out = np.zeros(len(p), np.int64)
    at, own, share = -1, 0.0, 0.0  # the open entry, its size and fraction
    for j, (q, size, u) in enumerate(zip(p.tolist(), sizes.tolist(), draws.tolist(), strict=True)):
        if q <= _EPS or q >= 1 - _EPS or size == 0:
            out[j] = int(u < q) if _EPS < q < 1 - _EPS else int(q > 0.5)
            continue
        if at < 0:
            at, own, share = j, size, q
            continue
        gain, loss = min(own * (1 - share), size * q), min(own * share, size * (1 - q))
        moved = gain if u * (gain + loss) < loss else -loss
        share, q = share + moved / own, q - moved / size
        if share <= _EPS or share >= 1 - _EPS:
            out[at], at, own, share = int(share > 0.5), j, size, q
        else:
            out[j] = int(q > 0.5)
        if share <= _EPS or share >= 1 - _EPS:
            out[at], at = int(share > 0.5), -1
    return out, at, share if at >= 0 else 0.0


def _settled(t: pa.Table, out: np.ndarray, at: int, share: float) -> pa.Table:
    """``t`` with up, open and p: what ``pivotal`` found."""
    is_open = np.arange(len(t)) == at
    if "p" in t.column_names:
        t = t.drop_columns(["p"])
    return t.append_column("up", pa.array(out, pa.int64())).append_column("open", pa.array(is_open)).append_column("p", pa.array(np.where(is_open, share, 0.0)))


def _draws(n: int, *key) -> np.ndarray:
    seed = xxhash.xxh64_intdigest("\x1f".join(map(str, key)))
    return np.random.Generator(np.random.PCG64(seed)).random(n)


def mix(docs: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_copies: float = MAX_COPIES, seed: int = SEED, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of ``docs``."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t"))
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"),
    ).select("doc_id", "source", key.alias("key"), F.xxhash64("text").alias("same"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    grouped = own.groupBy("doc_id", "source", "key", "same", "size").agg(F.count("*").alias("rows"))
    pieces = grouped.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / PIECE)))).repartition("doc_id", "same", "piece")
    last = F.least(F.col("rows"), (F.col("piece") + 1) * PIECE) - 1
    base = stored(pieces.withColumn("tie", F.explode(F.sequence(F.col("piece") * PIECE, last))).drop("rows", "piece"), "mix-sizes")
    targets = stored(source_targets(base, weights, total_share, max_copies), "mix-targets")
    share = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_copies)))).otherwise(0.0)
    blocks = F.greatest(F.ceil(F.col("n_docs") / block_rows), F.lit(1))
    dealt = (
        base.join(targets, "key")
        .withColumns({"share": share, "block": F.pmod(F.xxhash64("doc_id", "same", "tie", F.lit(seed)), blocks)})
        .withColumn("sure", F.floor(F.col("share") + _EPS))
        .withColumn("p", F.greatest(F.col("share") - F.col("sure"), F.lit(0.0)))
    )

    def settle(t: pa.Table) -> pa.Table:
        of = lambda c: t[c].to_numpy()
        t = t.take(np.lexsort((of("tie"), of("same"), t["doc_id"].fill_null(-(1 << 63)).to_numpy(), of("size")))[::-1])
        draws = _draws(len(t), seed, 0, t["key"][0].as_py(), t["block"][0].as_py())
        return _settled(t, *pivotal(of("p"), of("size").astype(float), draws)).select(["doc_id", "source", "key", "size", "source_size", "target", "block", "sure", "up", "open", "p"])

    schema = "doc_id long, source string, key string, size long, source_size long, target double, block long, sure long, up long, open boolean, p double"
    settled = stored(dealt.select("doc_id", "same", "tie", "source", "key", "size", "source_size", "target", "block", "sure", "p").groupBy("key", "block").applyInArrow(settle, schema), "mix-settled")

    def combine(level: int, last: bool):
        def run(t: pa.Table) -> pa.Table:
            of = lambda c: t[c].to_numpy()
            t = t.take(np.lexsort((of("leaf"), of("size")))[::-1])
            draws = _draws(len(t) + 1, seed, level, t["key"][0].as_py(), t["block"][0].as_py())
            out, at, share = pivotal(of("p"), of("size").astype(float), draws[:-1])
            if last and at >= 0:
                out[at], at = int(draws[-1] < share), -1
            return _settled(t, out, at, share).select(["key", "leaf", "block", "size", "p", "up", "open"])

        return run

    left = settled.filter("open").select("key", F.col("block").alias("leaf"), "block", "size", "p")
    most = targets.agg(F.max(F.ceil(F.col("n_docs") / block_rows))).first()[0] or 1
    level, decided = 0, None
    while True:
        level, most = level + 1, -(-most // fan)
        left = left.withColumn("block", F.floor(F.col("block") / fan))
        done = stored(left.groupBy("key", "block").applyInArrow(combine(level, most <= 1), "key string, leaf long, block long, size long, p double, up long, open boolean"), "mix-tree")
        now = done.filter("not open").select("key", F.col("leaf").alias("block"), F.lit(True).alias("open"), F.col("up").alias("late"))
        decided = now if decided is None else decided.union(now)
        if most <= 1:
            break
        left = done.filter("open").select("key", "leaf", "block", "size", "p")
    copies = F.col("sure") + F.col("up") + F.coalesce("late", F.lit(0))
    return (
        settled.join(decided, ["key", "block", "open"], "left")
        .withColumn("copies", copies)
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: how many times each document goes into the mix."""
    return mix(docs)
