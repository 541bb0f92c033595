"""A trie of conversation prefixes, rolled up by pointer jumping.

Order. Turns are ordered by ``turn`` (null first). Turns of one conversation that share a number
are put in order of the MD5 of role and text. Places are counted in ranges of (conversation,
turn), whose sizes are then added up, so that no conversation has to fit a task.

Nodes. Each prefix has a digest: a chain of MD5 over its turns' digests. Chains run over at most
``run`` turns; the last digests of whole runs are items of a chain one level up, which gives later
runs their start. A node is the digest of a prefix, and its edge leads to the digest of the prefix
that is one turn shorter. Only digests, ids and counts move; each text is read once.

Rollup. Every node holds a pointer to an ancestor, at first its parent, and sums over the nodes
below it that are nearer than the pointer's length. In a round all nodes add their sums to the node
they point to, and then point to where that one points: twice as far. After as many rounds as the
depth has bits each node's sums cover its subtree. Sums for one ancestor are added up before they
are shuffled; nodes too near the root to jump again leave the next round. Each round is written as
a table.

Hash of the conversations that end at a node. SHA-256 is one sequence by definition; ids are sorted
in ranges of (node, id), written as blocks of text, and a node's blocks are hashed as a stream.

Edge cases: rows without ``conv_id`` take no part; null role or text is empty; a null turn comes
first; repeated rows are turns of their own; a conversation that loses all its turns ends at the
root; other columns are ignored; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table
from .filter_audit import word_list

RUN = 512
HEADS, EVERY = 4, 20  # the contract's mixing of first turns: crc32(id) % HEADS turns of conversation id - id % EVERY
BLOCK_IDS = 1 << 14
ROOT = b""


def places(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest, words of each turn, without a task for each conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = turns.filter("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), F.size(word_list(text)).cast("long").alias("words"))
    rows = stored(rows, "trie-digests")  # sampled and sorted without reading the texts again
    in_order = [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]  # row: so that equal turns can be split
    spread = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("conv_id", *in_order)
    spread = stored(spread.withColumn("pile", F.spark_partition_id()), "trie-turns")
    sizes = spread.groupBy("conv_id", "pile").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("pile").rowsBetween(Window.unboundedPreceding, -1))
    begun = sizes.withColumn("before", before).filter("before > 0").drop("n")  # at most one conversation for each pile
    own = F.row_number().over(Window.partitionBy("pile", "conv_id").orderBy(*in_order)).cast("long")
    return spread.withColumn("own", own).join(F.broadcast(begun), ["conv_id", "pile"], "left").select("conv_id", (F.col("own") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "words")


def with_shared_heads(turns: DataFrame, heads: int = HEADS, every: int = EVERY) -> DataFrame:
    """conv_id, pos, digest, words of the rebuilt conversations, with one row of pos 0 for each conversation.

    The first h turns, h = crc32(id) % heads, are replaced by those of conversation id - id % every.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumns({"h": h, "donor": F.col("conv_id") - F.col("conv_id") % every})
    donors = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("donor"), F.col("n").alias("has"))
    convs = stored(convs.join(donors, "donor", "left").withColumn("given", F.least("h", F.coalesce("has", F.lit(0)))), "trie-conversations")
    first = turns.filter((F.col("conv_id") % every == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "donor")
    given = convs.filter("given > 0").select("conv_id", "donor", "given").join(first, "donor").filter("pos <= given").select("conv_id", "pos", "digest", "words")
    moved = convs.filter("given < h").select("conv_id", (F.col("h") - F.col("given")).alias("by"))
    own = turns.filter(F.col("pos") > h).join(moved, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("by", F.lit(0))).alias("pos"), "digest", "words")
    tops = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(ROOT).alias("digest"), F.lit(0).cast("long").alias("words"))
    return given.union(own).union(tops)


def _chain(level: int):
    """mapInArrow: the digests of a run to those of the run's prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("items")
            chains = []
            for items in batch.column(at).to_pylist():
                before, chain = bytes([level]), []
                for item in items:
                    chain.append(before := md5(before + item["digest"]).digest())
                chains.append(chain)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chains, pa.list_(pa.binary()))], [*batch.schema.names, "chain"])

    return run


def prefix_digests(items: DataFrame, run: int = RUN, level: int = 0) -> DataFrame:
    """Runs of at most ``run`` items (conv_id, pos, digest, words): conv_id, part, items, keys, parents.

    ``keys`` are the digests of all prefixes that end in the run, ``parents`` those of the prefixes
    that are one item shorter.
    """
    entry = F.struct("pos", "digest", "words")
    part = F.floor((F.col("pos") - 1) / run)
    grouped = items.withColumn("part", part).repartition("conv_id", "part").groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(entry)).alias("items"))
    runs = stored(grouped.mapInArrow(_chain(level), "conv_id long, part long, items array<struct<pos:long,digest:binary,words:long>>, chain array<binary>"), f"trie-runs-{level}")
    whole = runs.filter(F.size("chain") == run).select("conv_id", (F.col("part") + 1).alias("pos"), F.element_at("chain", -1).alias("digest"), F.lit(0).cast("long").alias("words"))
    if whole.isEmpty():
        return runs.select("conv_id", "part", "items", F.col("chain").alias("keys"), _shifted(F.col("chain"), F.lit(ROOT)).alias("parents"))
    above = prefix_digests(whole, run, level + 1).select("conv_id", F.explode(F.arrays_zip("items", "keys", "parents")).alias("x"))
    above = above.select("conv_id", F.col("x.items.pos").alias("part"), F.col("x.keys").alias("start"), F.col("x.parents").alias("start_before"), F.col("x.items.digest").alias("last"))
    joined = runs.join(above, ["conv_id", "part"], "left")
    under = lambda start, own: F.unhex(F.md5(F.concat(start, own)))
    keys = F.when(F.col("part") == 0, F.col("chain")).otherwise(F.transform("chain", lambda x: under(F.col("start"), x)))
    first = F.when(F.col("part") == 0, F.lit(ROOT)).when(F.col("part") == 1, F.col("last")).otherwise(under(F.col("start_before"), F.col("last")))
    named = joined.withColumns({"keys": keys, "first": first})
    return named.select("conv_id", "part", "items", "keys", _shifted(F.col("keys"), F.col("first")).alias("parents"))


def _shifted(keys: Column, first: Column) -> Column:
    return F.concat(F.array(first), F.slice(keys, 1, F.size(keys) - 1))


def sums_below(nodes: DataFrame, measures: list[str]) -> DataFrame:
    """key and measures summed over all nodes below it (for nodes that have any; the root is ``ROOT``).

    ``nodes`` (stored; key, parent, depth and measures) holds all but the root.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    now, rounds, reach = nodes.select("key", F.col("parent").alias("ptr"), "depth", *measures), [], 1
    while True:
        rounds.append(now.select(F.col("ptr").alias("key"), *measures))
        if 2 * reach > deepest:
            break
        reach *= 2
        far = now.filter(F.col("depth") >= reach)
        got = rounds[-1].groupBy("key").agg(*[F.sum(m).alias(f"{m}_more") for m in measures])
        on = now.select(F.col("key").alias("ptr"), F.col("ptr").alias("next"))
        far = far.join(got, "key", "left").select("key", "ptr", "depth", *[(F.col(m) + F.coalesce(f"{m}_more", F.lit(0))).alias(m) for m in measures])
        jumped = far.filter(F.col("depth") > reach).join(on, "ptr").select("key", F.col("next").alias("ptr"), "depth", *measures)
        landed = far.filter(F.col("depth") == reach).select("key", F.lit(ROOT).alias("ptr"), "depth", *measures)
        now = stored(jumped.union(landed), "trie-jumps")
    every = rounds[0]
    for r in rounds[1:]:
        every = every.union(r)
    return every.groupBy("key").agg(*[F.sum(m).alias(m) for m in measures])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) to (key, first, ids): ids as text, comma-joined, at most BLOCK_IDS of one key."""
    key, ids, out = None, [], []

    def flush(least: int) -> list[pa.RecordBatch]:
        if len(out) < least or not out:
            return []
        made = pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())]))
        out.clear()
        return [made]

    def close() -> None:
        if ids:
            out.append({"key": key, "first": ids[0], "ids": ",".join(map(str, ids))})
            ids.clear()

    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key or len(ids) >= BLOCK_IDS:
                close()
                key = k
                yield from flush(256)
            ids.append(c)
    close()
    yield from flush(1)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, first, ids) to (key, ends_sha256), one block at a time."""
    key, state = None, None
    for batch in batches:
        keys, hashes = [], []
        for i in range(batch.num_rows):
            k, block = batch.column(0)[i].as_py(), batch.column(2)[i].as_py().encode()
            if state is not None and k == key:
                state.update(b"," + block)
                continue
            if state is not None:
                keys.append(key)
                hashes.append(state.hexdigest())
            key, state = k, sha256(block)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["key", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def ends_hash(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: SHA-256 of the ids (key, conv_id) of each key, ascending and comma-joined."""
    blocks = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_blocks, "key binary, first long, ids string")
    return blocks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends_sha256 string")


def trie(sequences: DataFrame, run: int = RUN) -> DataFrame:
    """One row per node of the trie of ``sequences`` (conv_id, pos, digest, words; pos 0 for each conversation)."""
    runs = stored(prefix_digests(sequences.filter("pos > 0"), run), "trie-keys")
    paths = runs.select("conv_id", F.explode(F.arrays_zip("items", "keys", "parents")).alias("x"))
    steps = paths.select("conv_id", F.col("x.keys").alias("key"), F.col("x.parents").alias("parent"), F.col("x.items.pos").alias("depth"), F.col("x.items.words").alias("words"))
    grouped = steps.groupBy("key", "parent", "depth", "words").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    convs = sequences.filter("pos = 0").select("conv_id")
    last = runs.groupBy("conv_id").agg(F.max_by(F.element_at("keys", -1), "part").alias("key"))
    ends = stored(convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("key", F.lit(ROOT)).alias("key")), "trie-ends")
    grouped = stored(grouped, "trie-nodes")
    top = ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "conv_id", "n_convs"
    )
    children = grouped.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    own = grouped.unionByName(top).join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = own.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    own = stored(own, "trie-own")
    below = sums_below(own.filter("depth > 0"), ["leaves", "saved"]).select("key", F.col("leaves").alias("leaves_below"), F.col("saved").alias("saved_below"))
    parents = own.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = own.filter("depth > 1").join(parents, "parent").select("key", "parent_conv_id")
    first = own.filter("depth = 1").join(F.broadcast(parents.filter(F.col("parent") == F.lit(ROOT))), "parent").select("key", "parent_conv_id")
    parents = stored(named.union(first), "trie-parents")
    zero = F.lit(0)
    return (
        own.join(below, "key", "left")
        .join(parents, "key", "left")
        .join(ends_hash(ends), "key", "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            (F.col("leaves") + F.coalesce("leaves_below", zero)).alias("n_leaves"),
            (F.col("saved") + F.coalesce("saved_below", zero)).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )


def conversation_trie(conversations: DataFrame, heads: int = HEADS, every: int = EVERY, run: int = RUN) -> DataFrame:
    """The trie of the conversations rebuilt by ``with_shared_heads``; with ``heads=1`` of those as they are."""
    turns = stored(places(conversations), "trie-places")
    return trie(stored(with_shared_heads(turns, heads, every), "trie-sequences"), run)


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, digest) AS pos FROM t
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS donor, xor(list_reduce(
      list_prepend(4294967295, list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(conv_id AS VARCHAR), i, 1)))),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, pos, digest, words FROM c JOIN o ON o.conv_id = c.donor AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, pos, digest, words FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h
), p AS (
  SELECT conv_id, row_number() OVER w AS depth, words, string_agg(digest, '') OVER w AS key FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), e AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p
), n AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM e GROUP BY key, depth
), k AS (
  SELECT left(key, 32 * (depth - 1)) AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
), full_nodes AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN k.key IS NULL THEN 1 ELSE 0 END AS leaf FROM n LEFT JOIN k USING (key)
), s AS (
  SELECT left(key, 32 * d) AS key, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_nodes) GROUP BY 1
)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(f.ids) AS ends_sha256
FROM full_nodes f JOIN s USING (key) LEFT JOIN n u ON f.depth > 0 AND u.key = left(f.key, 32 * (f.depth - 1))
"""
