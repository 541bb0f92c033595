import re
import zlib
from collections import defaultdict
from hashlib import md5, sha256

import duckdb
import pytest

from placeloom.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, pos string, n string, key string"


def plain(rows, heads=4, every=20):
    """Rows (conv_id, turn, role, text) to the set of the trie's rows."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        rebuilt = own.get(c - c % every, [])[:h] + turns[h:]
        for d in range(len(rebuilt) + 1):
            nodes[tuple(rebuilt[:d])].append((c, d == len(rebuilt)))
    out, kids = set(), defaultdict(int)
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    for k, members in nodes.items():
        under = [x for x in nodes if x[: len(k)] == k]
        saved = sum((len(nodes[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in under if x)
        ends = ",".join(str(c) for c in sorted(c for c, e in members if e))
        parent = min(c for c, _ in nodes[k[:-1]]) if k else None
        out.add((min(c for c, _ in members), len(k), parent, len(members), kids[k], sum(not kids[x] for x in under), saved, sha256(ends.encode()).hexdigest()))
    return out


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {k: t for k, t in df.dtypes if k != "ends_sha256"} == dict.fromkeys(df.columns[:-1], "bigint")
    rows = [tuple(r) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)


def cases():
    rows = []
    for c in [*range(0, 47), 61, 62, 63, 64]:  # 60 is absent, so 61 to 64 get no head
        for t in range(1 + (c * 7) % 6):
            rows.append((c, t, ["user", "assistant", None][t % 3], ["hi  there", "ok", "", None, f"own {c % 5}"][(t + c // 9) % 5]))
    rows += [(100, None, "user", "null turn"), (100, 3, "user", "b"), (100, 3, "user", "a"), (100, 3, "user", "a"), (None, 1, "user", "lost"), (101, 0, "user", "w " * 9000), (103, 0, "a", "bc"), (104, 0, "ab", "c")]
    rows += [(c, t, "user", f"deep {t if t < 17 else c}") for c in (120, 140) for t in range(21)]
    return rows


@pytest.mark.parametrize("run", [512, 3])
def test_trie(spark, run):
    assert got(T.conversation_trie(make(spark, cases()), run=run)) == plain(cases())


def test_sql_gives_the_same():
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", cases())
    assert set(con.execute(T.OP12_SQL).fetchall()) == plain(cases())


def test_one_conversation_for_many(spark):
    """Most conversations are the same, and one has most turns."""
    rows = [(c, t, "user", f"t{t}") for c in range(0, 4000, 20) for t in range(2)] + [(7, t, "user", "same") for t in range(150)]
    want = plain(rows, heads=1)
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        assert got(T.conversation_trie(make(spark, rows).repartition(4), heads=1, run=16)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_turnless_and_empty(spark):
    assert T.conversation_trie(make(spark, [])).count() == 0
    assert T.conversation_trie(make(spark, [(None, 1, "a", "b")])).count() == 0
    lost = next(c for c in range(1, 100) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    assert got(T.conversation_trie(make(spark, [(lost, 1, "a", "b")]))) == {(lost, 0, None, 1, 0, 1, 0, sha256(str(lost).encode()).hexdigest())}


def test_blocks_of_ids(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_IDS", 7)
    ids = list(range(-50, 50)) + [10**12]
    rows = T.ends_hash(spark.createDataFrame([(b"k", i) for i in reversed(ids)] + [(b"", 3)], "key binary, conv_id long").repartition(3)).collect()
    assert {bytes(r.key): r.ends_sha256 for r in rows} == {b"k": sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), b"": sha256(b"3").hexdigest()}
