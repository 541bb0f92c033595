import hashlib
import random
import zlib

import pytest

from placeloom.llm import media as M


@pytest.mark.parametrize("n", [0, 1, 63, 64, 128, 167, 168, 169, 176, 184, 352, 16384, 16448, 50_000, 200_000])
def test_round_trip(n):
    data = random.Random(n).randbytes(n)
    want = M.payload_of(data)
    assert len(want) % 64 == 0 and len(want) >= 64 and want.startswith(data)
    for unit in (64, 1000, M.UNIT_BYTES):
        stream = M.mux(want, unit)
        assert len(stream) % 188 == 0 and set(stream[::188]) == {0x47}
        got = M.demux(stream)
        assert got["payload"] == want and got["continuity_errors"] == 0 and got["streams"] == 1
        assert [u["pts"] for u in got["units"]] == [i * M.TICKS for i in range(-(-len(want) // unit))]
        assert [u["random_access"] for u in got["units"]] == [i % M.ACCESS_EVERY == 0 for i in range(len(got["units"]))]
        assert not any(u["damaged"] for u in got["units"]) and sum(u["length"] for u in got["units"]) == len(want)


def test_known_crc():
    assert M.crc32_mpeg(b"123456789") == 0x0376E6E7


def packets(stream):
    return [stream[i : i + 188] for i in range(0, len(stream), 188)]


def test_damage_is_noticed():
    data = random.Random(5).randbytes(64_000)
    parts = packets(M.mux(data, 16_000))
    got = M.demux(b"".join(parts[:10] + parts[11:]))
    assert got["continuity_errors"] == 1 and [u["damaged"] for u in got["units"]] == [True, False, False, False]
    assert got["payload"].endswith(data[16_000:]) and [u["offset"] for u in got["units"]][1] == 16_000 - 184
    # the last packet of a unit, its first one, and the end of the stream
    per_unit = (len(parts) - 2) // 4
    for lost, hurt in ((2 + per_unit - 1, [0]), (2 + per_unit, [0]), (len(parts) - 1, [len(M.demux(b"".join(parts))["units"]) - 1])):
        got = M.demux(b"".join(parts[:lost] + parts[lost + 1 :]))
        assert [i for i, u in enumerate(got["units"]) if u["damaged"]] == hurt
    marked = parts[:20] + [parts[20][:1] + bytes([parts[20][1] | 0x80]) + parts[20][2:]] + parts[21:]
    assert [u["damaged"] for u in M.demux(b"".join(marked))["units"]] == [True, False, False, False]
    stream = b"".join(parts)
    for bad in (b"", stream[:-1], b"x" * 188, stream[:7] + b"\xff" + stream[8:], stream[188:], stream[:188] + stream[376:]):
        with pytest.raises(ValueError):
            M.demux(bad)


def test_what_is_legal_is_no_damage():
    data = random.Random(6).randbytes(40_000)
    parts = packets(M.mux(data, 10_000))
    null = b"\x47\x1f\xff\x10" + b"\xff" * 184
    for some in (
        parts[:9] + [null, parts[9], parts[9], null] + parts[10:],  # null packets and a repetition
        [parts[0], parts[1], *parts],  # repeated tables
        parts[:2] + [b"\x47\x01\x00\x20\xb7\x10" + b"\x00" * 182] + parts[2:],  # a packet without data, counter unchanged
    ):
        got = M.demux(b"".join(some))
        assert got["payload"] == data and not any(u["damaged"] for u in got["units"]) and got["continuity_errors"] == 0
    first = next(i for i, x in enumerate(parts) if i > 2 and x[1] & 0x40)
    jump = [x[:3] + bytes([x[3] & 0xF0 | (x[3] + 7 & 15)]) + (x[4:5] + bytes([x[5] | 0x80]) if i == 0 else x[4:6]) + x[6:] for i, x in enumerate(parts[first:])]
    got = M.demux(b"".join(parts[:first] + jump))  # an announced discontinuity
    assert got["payload"] == data and got["continuity_errors"] == 0
    for wide in (lambda x: b"\0\0\0\0" + x, lambda x: x + b"\0" * 16):
        assert M.demux(b"".join(map(wide, parts)))["payload"] == data
    tail = M.demux(b"".join(parts[:2] + parts[5:]))  # joined in the middle of a unit
    assert tail["payload"] == data[10_000:] and not any(u["damaged"] for u in tail["units"])


def test_tables_that_span_packets():
    data = random.Random(7).randbytes(1000)
    parts = packets(M.mux(data))
    extra = b"".join(bytes([0x06]) + (0xE000 | 0x200 + i).to_bytes(2, "big") + b"\xf0\x00" for i in range(60))
    body = (0xE000 | M.DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([6]) + (0xE000 | M.DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + extra
    pmt = M._section(2, 1, body)
    head = lambda i: bytes([0x47, 0x40 * (i == 0) | M.PMT_PID >> 8, M.PMT_PID & 255, 0x10 | i])
    cuts = [b"\0" + pmt[:183], pmt[183:]]
    assert len(pmt) > 184
    got = M.demux(b"".join([parts[0], *[head(i) + c.ljust(184, b"\xff") for i, c in enumerate(cuts)], *parts[2:]]))
    assert got["payload"] == data and got["streams"] == 61


def test_query(spark, make_docs):
    texts = [None, "", "abc", "é" * 40_000, "abc", "z" * 64]
    docs = make_docs(texts)
    rows = {r.doc_id: r for r in M.decode(M.encode(docs)).collect()}
    for i, t in enumerate(texts):
        p = M.payload_of((t or "").encode())
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, bytes(r.payload)) == (len((t or "").encode()), len(p), p)
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-64:])
        assert [u.pts for u in r.units] == [j * M.TICKS for j in range(len(r.units))] and not any(u.damaged for u in r.units)
        assert r.media_sha256 == hashlib.sha256(M.mux(p)).hexdigest() and r.media_bytes == len(M.mux(p)) and r.error is None
    assert M.encode(make_docs([])).count() == 0
    bad = spark.createDataFrame([(1, bytearray(b"nothing")), (2, None)], "k long, media binary")
    assert [(r.k, r.payload, r.error is None) for r in M.decode(bad).orderBy("k").collect()] == [(1, None, False), (2, None, False)]
