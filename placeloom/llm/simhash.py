"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint has 64 bits; bit *b* is set if more than half of the XXH64 values of
its word shingles have it set. Documents whose fingerprints differ in at most two bits are
linked, and a component is what links reach.

Search. Equal fingerprints are merged first, so that copies cost one row however many there
are. The distinct fingerprints are cut into two 32-bit segments. Two codes within distance 2
either agree within one bit in the first segment or exactly in the second (if the first differs
in two bits, the second differs in none), so every code probes the first table with the Hamming
ball of radius 1 around its segment (33 values) and the second with its segment alone. Matches
are verified by the distance of the whole codes.

Crowded buckets. A bucket of more than ``bucket_limit`` codes is not expanded into pairs. Its
members, and all codes that would probe it, are filed under the 65 codes within one bit of
their own. Codes filed under one key differ in at most two bits, codes that differ in at most
two bits share such a key, and no key holds more than 65 codes: the same links come out, in
linear space.

Edge cases: a null or empty text has fingerprint zero and links like any other; rows with equal
``doc_id`` each keep their row; a null ``doc_id`` gets its component's smallest id, or null when
the component has none; extra columns are ignored.

The pipeline's stage links texts whose sets of word 5-shingles have a Jaccard similarity of 0.8 or
more (``similar_texts``). It finds them by fingerprints of these shingles and the same multi-index
hashing first (``alike``): texts within two bits are candidates, and their whole sets are compared. A
distance says too little about a similarity of 0.8 to find all of them (two such texts differ in about
10 bits), so an exact join of the sets follows for those that are not in one component yet. Two sets
with a similarity of 0.8 share one of their first ``n - ceil(0.8 n) + 1`` shingles in any common order;
the order is by how common a shingle's bucket is, so that common lines come last. From the first
shingle that two sets share no more can be common than what is left of either set, so the pair is
dropped where it is formed if that is too little. Other pairs are candidates, and their whole sets
are compared. First every candidate is compared with one text: of the first texts of its shingles
(those in whose prefix a shingle comes earliest, so that they have the fewest words of their own),
the earliest. Then it is compared with ``FIRSTS`` first texts of each shingle, if they are not yet
in its component; then candidates that are still not in one component are compared with each
other. So a large group of near copies costs a few comparisons for each of them, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored, table

SEED, SHINGLE, BUCKET_LIMIT = 42, 3, 4
_ROWS = 1 << 16
#: The stage: words of a shingle, least similarity as a fraction, buckets that shingles are counted in.
STAGE_SHINGLE, STAGE_LEAST, SKETCH = 5, (4, 5), 1 << 20
#: Texts of a shingle that all its others are compared with before they are compared with each other.
FIRSTS = 8
#: Tables of ids are broadcast up to so many rows.
BROADCAST_ROWS = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    data = text.encode() if isinstance(text, str) else text or b""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        digests = xxhash.xxh64_digest(joined, seed)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: -shingle] + 1))
        h = xxhash.xxh64_digest
        digests = b"".join([h(joined[s:e], seed) for s, e in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)])
    hashes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _ROWS):
        ones += np.unpackbits(hashes[i : i + _ROWS], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) for each row of ``docs`` (doc_id, text); fp is the signed form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(x, shingle, seed) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


def _segment(n: int) -> Column:
    return F.shiftrightunsigned("fp", 32) if n == 0 else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))


def _flipped(col: Column, bits: int) -> Column:
    masks = [0, *(1 << b if b < 63 else -(1 << 63) for b in range(bits))]
    return F.array(*[col.bitwiseXOR(F.lit(m).cast("long")) for m in masks])


def links(codes: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (u, v) that connect all codes (distinct ``fp``) within two bits of each other."""
    key = lambda seg, col: F.transform(col, lambda v: F.struct(F.lit(seg).alias("seg"), v.alias("val")))
    entries = codes.select("fp", F.inline(F.array(*[F.struct(F.lit(s).alias("seg"), _segment(s).alias("val")) for s in (0, 1)])))
    sizes = entries.groupBy("seg", "val").agg(F.count("*").alias("n"))
    crowded = sizes.filter(F.col("n") > bucket_limit)
    near_first = crowded.filter("seg = 0").select(F.explode(_flipped(F.col("val"), 32)).alias("hi")).distinct().withColumn("c0", F.lit(True))
    second = crowded.filter("seg = 1").select(F.col("val").alias("lo"), F.lit(True).alias("c1"))
    flagged = (
        codes.withColumns({"hi": _segment(0), "lo": _segment(1)})
        .join(near_first, "hi", "left")
        .join(second, "lo", "left")
        .select("fp", "hi", "lo", F.coalesce("c0", "c1", F.lit(False)).alias("crowded"))
    )
    probes = F.concat(
        key(0, _flipped(F.col("hi"), 32)),
        key(1, F.array("lo")),
        F.when(F.col("crowded"), key(2, _flipped(F.col("fp"), 64))).otherwise(F.array().cast("array<struct<seg:int,val:bigint>>")),
    )
    probed = stored(flagged.select("fp", F.inline(probes)), "simhash-probes")
    cold = entries.join(sizes.filter((F.col("n") <= bucket_limit)), ["seg", "val"]).select("seg", "val", F.col("fp").alias("other"))
    pairs = (
        probed.filter("seg < 2")
        .join(cold, ["seg", "val"])
        .filter((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= 2))
        .select(F.col("other").alias("u"), F.col("fp").alias("v"))
    )
    # at most 65 codes are filed under a key
    filed = probed.filter("seg = 2").groupBy("val").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = filed.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).filter("u <> v")
    return pairs.union(stars).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (u, v) reaches.

    Alternates large-star and small-star steps until every edge points at a root. Each step
    aggregates minima and joins them back, so no node's neighbours meet in one row.
    """
    edges = stored(edges.select("u", "v").filter("u <> v").distinct(), "simhash-edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = stored(small.filter("u <> v").distinct(), "simhash-edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        before = now


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    fps = stored(fingerprints(docs, shingle, seed), "simhash-fps")
    codes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-codes")
    roots = connected(links(codes.select("fp"), bucket_limit))
    labelled = codes.join(roots, codes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = labelled.join(ids, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def shingle_set(text: str | bytes | None, shingle: int = STAGE_SHINGLE, seed: int = SEED) -> np.ndarray:
    """The different 64-bit hashes of a text's word shingles, in order; one hash of all words if they are fewer."""
    data = text.encode() if isinstance(text, str) else text or b""
    words = data.lower().split()
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64).view(np.int64)
    h = xxhash.xxh64_intdigest
    one = np.array([h(w, seed) for w in words], np.uint64)
    n = len(words) - shingle + 1
    out = one[:n].copy()
    for k in range(1, shingle):
        out = (out ^ (out >> np.uint64(29))) * _MIX + one[k : k + n]
    return np.unique(((out ^ (out >> np.uint64(32))) * _MIX).view(np.int64))


def _sets_of(batch: pa.RecordBatch, column: int, shingle: int, seed: int = SEED) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Pieces of a batch with the shingle sets of their texts."""
    for i in range(0, batch.num_rows, 500):
        part = batch.slice(i, 500)
        yield part, [shingle_set(x, shingle, seed) for x in part.column(column).cast(pa.binary()).to_pylist()]


def _bucket_of(grams: np.ndarray) -> np.ndarray:
    return grams & (SKETCH - 1)


def _bucket_counts(docs: DataFrame, shingle: int) -> np.ndarray:
    """How many shingles of all texts fall in each bucket; at most SKETCH rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for _, sets in _sets_of(batch, 0, shingle):
                np.add.at(total, _bucket_of(np.concatenate(sets)), 1)
        for i in range(0, SKETCH, _ROWS):
            at = i + np.flatnonzero(total[i : i + _ROWS])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = map_batches(docs.select(F.col("text").cast("string")), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SKETCH, np.int64)
    out[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return out


def _prefixes(docs: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """(node, n, prefix): the size of each text's set and the shingles of which similar sets share one."""
    counts = docs.sparkSession.sparkContext.broadcast(_bucket_counts(docs, shingle))
    up, down = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets_of(batch, 1, shingle):
                first = [grams[np.lexsort((grams, counts.value[_bucket_of(grams)]))[: len(grams) + (-up * len(grams)) // down + 1]] for grams in sets]
                cuts = np.cumsum([0, *map(len, first)]).astype(np.int32)
                sizes = np.array([len(x) for x in sets], np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(first)))], ["node", "n", "prefix"])

    return map_batches(docs.select("node", F.col("text").cast("string")), run, "node long, n int, prefix array<long>")


def _sized(df: DataFrame) -> DataFrame:
    """``df``, which is stored, for a join that need not shuffle the other side if ``df`` is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _similar(pairs: DataFrame, docs: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """Those of ``pairs`` (u, v) whose whole sets are similar enough. Texts are moved to the pairs, not
    sets: they are the smaller."""
    up, down = least
    pairs = stored(pairs.select("u", "v").distinct(), "near-pairs")
    nodes = stored(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "near-nodes")
    own = stored(docs.join(_sized(nodes), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "near-texts")
    both = pairs.join(own.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(own.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                keep = []
                for a, b in zip(*(part.column(c).to_pylist() for c in ("a", "b")), strict=True):
                    one, other = shingle_set(a, shingle), shingle_set(b, shingle)
                    met = len(np.intersect1d(one, other, assume_unique=True))
                    keep.append(met * down >= (len(one) + len(other) - met) * up)
                yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return stored(map_batches(both.select("u", "v", "a", "b"), run, "u long, v long"), "near-edges")


def alike(docs: DataFrame, shingle: int = STAGE_SHINGLE, least: tuple[int, int] = STAGE_LEAST) -> DataFrame:
    """(u, v): texts of ``docs`` (node, text) with fingerprints within two bits whose whole sets are similar enough.

    Texts of one fingerprint are compared with the first of them, and the first ones of linked fingerprints.
    """
    fps = fingerprints(docs.select(F.col("node").alias("doc_id"), "text"), shingle).groupBy(F.col("doc_id").alias("node")).agg(F.first("fp").alias("fp"))
    fps = stored(fps, "near-fps")
    codes = stored(fps.groupBy("fp").agg(F.min("node").alias("first")), "near-codes")
    same = fps.join(codes, "fp").filter("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    of = lambda name: codes.select(F.col("fp").alias(name), F.col("first").alias(f"{name}_first"))
    near = links(codes.select("fp")).join(of("u"), "u").join(of("v"), "v").select(F.col("u_first").alias("u"), F.col("v_first").alias("v"))
    return _similar(same.union(near), docs, shingle, least)


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) that are in different components."""
    of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    rooted = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
    return rooted.filter(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")


def _between(postings: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of ``postings`` whose shingle is in more than one component, with their ``root``."""
    rooted = postings.join(roots, "node", "left").select("gram", "node", "n", "i", F.coalesce("root", "node").alias("root"))
    apart = rooted.groupBy("gram").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("gram")
    return stored(rooted.join(apart, "gram", "left_semi"), "near-open")


def _first(*more: str) -> Column:
    """The posting of a shingle that comes first in its text's prefix: that text has the fewest rare
    shingles, so it is near the middle of a group of near copies."""
    return F.min(F.struct((F.col("i") / F.col("n")).alias("at"), "node", "n", "i", *more)).alias("first")


def similar_texts(docs: DataFrame, shingle: int = STAGE_SHINGLE, least: tuple[int, int] = STAGE_LEAST) -> DataFrame:
    """(node, root) of each of ``docs`` (node, text; one node for one text) that is linked to another.

    Linked are all texts whose sets of shingles have a Jaccard similarity of ``least`` or more. The
    sets are made again where they are read: they are larger than the texts.
    """
    up, down = least

    def may(n: str, i: str, m: str, j: str) -> Column:
        """Whether sets of n and m shingles may be similar if the i-th and j-th is the first that they share."""
        return F.least(F.col(n) - F.col(i), F.col(m) - F.col(j)) * (up + down) >= (F.col(n) + F.col(m)) * up

    links = alike(docs, shingle, least)
    one = _prefixes(docs, shingle, least).groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    postings = one.select("node", "n", F.posexplode("prefix").alias("i", "gram")).repartition("gram")
    keys = postings.groupBy("gram").agg(_first(), F.count("*").alias("texts")).filter("texts > 1").drop("texts")
    shared = stored(postings.join(keys, "gram").select("gram", "node", "n", "i", "first"), "near-postings")
    # one first text for each text, if the fingerprints leave it in another component
    stars = shared.filter((F.col("node") != F.col("first.node")) & may("n", "i", "first.n", "first.i"))
    stars = stars.groupBy(F.col("node").alias("u")).agg(F.min("first").alias("v")).select("u", F.col("v.node").alias("v"))
    links = links.union(_similar(_apart(stars, connected(links)), docs, shingle, least))
    # then up to FIRSTS first texts of each shingle, which the links so far leave in other components
    open_ = _between(shared.drop("first"), connected(links))
    firsts = open_.groupBy("gram", F.pmod("node", F.lit(FIRSTS)).alias("part")).agg(_first("root")).select("gram", "first")
    stars = open_.join(firsts, "gram").filter((F.col("root") != F.col("first.root")) & may("n", "i", "first.n", "first.i"))
    links = links.union(_similar(stars.select(F.col("node").alias("u"), F.col("first.node").alias("v")), docs, shingle, least))
    # then all texts that this leaves in other components
    open_ = _between(open_.drop("root"), connected(links))
    other = open_.select("gram", F.col("node").alias("v"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("root").alias("other"))
    pairs = open_.join(other, "gram").filter((F.col("node") < F.col("v")) & (F.col("root") != F.col("other")) & may("n", "i", "m", "j"))
    return connected(links.union(_similar(pairs.select(F.col("node").alias("u"), "v"), docs, shingle, least)))


def _told_apart(named: DataFrame) -> DataFrame:
    """``named`` (node, other and more), its ``node`` changed where texts with different ``other`` share it.

    ``node`` is one 64-bit hash of a text and ``other`` a second one. A text is known by both; as the
    joins carry ``node`` alone, all but one of the texts that share it get another one.
    """
    keys = named.groupBy("node", "other").agg(F.count("*").alias("rows"))
    shared = keys.groupBy("node").agg(F.min("other").alias("first"), F.count("*").alias("texts")).filter("texts > 1").select("node", "first")
    later = stored(keys.join(shared, "node").filter("other <> first").select("node", "other", F.xxhash64(F.lit("again"), "node", "other").alias("instead")), "near-shared")
    if later.isEmpty():
        return named
    return named.join(_sized(later), ["node", "other"], "left").withColumn("node", F.coalesce("instead", "node")).drop("instead")


def keep_one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of ``similar_texts``, one row stays.

    It is the one with the smallest doc_id (null last), then the smallest hash of the text and of
    the whole row. Rows travel as one struct, so that columns of any name come out as they went in.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    whole = F.xxhash64(*[F.col(f"row.`{c}`") for c in docs.columns])
    named = _told_apart(own.select("row", text.alias("text"), F.xxhash64(text).alias("node"), F.xxhash64(F.lit("second"), text).alias("other"), whole.alias("whole")))
    keys = stored(named.select("node", F.col("row.doc_id").alias("id"), "whole"), "near-keys").groupBy("node", "id", "whole").agg(F.count("*").alias("rows"))
    roots = similar_texts(named.select("node", "text"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "node", "whole", "rows")
    found = keys.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(order).alias("k"))
    found = stored(found.select("k.node", "k.id", "k.whole", "k.rows"), "near-kept")
    kept = named.select("row", "node", F.col("row.doc_id").alias("own_id"), F.col("whole").alias("own")).join(_sized(found), "node").filter(F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("whole")))
    same = kept.filter("rows > 1").dropDuplicates(["node"])  # rows that still tie are equal
    return kept.filter("rows = 1").union(same).select("row.*")
