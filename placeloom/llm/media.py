"""Media columns: MPEG transport streams (ISO/IEC 13818-1) in a binary column.

``mux`` stores a payload as one private-data elementary stream: a program association table, a
program map table, and one packetized elementary packet (PES) for each access unit of
``UNIT_BYTES``. Every PES carries a presentation timestamp; the first transport packet of each
carries a program clock reference, and that of every ``ACCESS_EVERY``-th the random-access indicator.
``demux`` reads any stream of 188-byte packets (or 192, or 204): it parses the program tables, which
may span packets, checking their CRC; checks the continuity counters of every packet identifier,
allowing for null packets, repeated packets and announced discontinuities; reassembles the PES
packets of the program's first stream and returns the payload with each access unit's timestamp,
place, random-access flag and whether it is damaged.

Edge cases: a null text counts as empty; an empty text is stored as 64 zero bytes; a binary value
that is no transport stream gives a null payload with the reason in ``error``. Equal texts give
equal streams. Extra columns pass through ``decode`` and are ignored by the query.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table

PACKET, PAD, UNIT_BYTES, TICKS, ACCESS_EVERY = 188, 64, 16384, 3600, 4
PMT_PID, DATA_PID, NULL_PID, PROGRAM = 0x1000, 0x0100, 0x1FFF, 1
_PRIVATE_STREAM, _STREAM_TYPE = 0xBD, 0x06
UNITS = pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("random_access", pa.bool_()), ("damaged", pa.bool_())])


@lru_cache(maxsize=256)
def crc32_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2: polynomial 0x04C11DB7, most significant bit first, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table_id: int, ext: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ext.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


@lru_cache(maxsize=1)
def _tables() -> bytes:
    pat = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([_STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
    return _table_packet(0, pat) + _table_packet(PMT_PID, pmt)


def _timestamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, pts >> 14 & 0xFE | 1, pts >> 7 & 255, pts << 1 & 0xFE | 1])


def mux(payload: bytes, unit_bytes: int = UNIT_BYTES) -> bytes:
    """The transport stream that carries ``payload``."""
    parts, counter = [_tables()], 0
    for i, at in enumerate(range(0, len(payload), unit_bytes)):
        data = payload[at : at + unit_bytes]
        pts = i * TICKS
        pes = b"\x00\x00\x01" + bytes([_PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(pts) + data
        clock = (pts << 15 | 0x7E00).to_bytes(6, "big")
        first, rest = pes[:176], pes[176:]
        full, tail = divmod(len(rest), 184)
        n = 1 + full + bool(tail)
        out = np.full((n, PACKET), 0xFF, np.uint8)
        out[:, 0], out[:, 1], out[:, 2] = 0x47, DATA_PID >> 8, DATA_PID & 255
        out[:, 3] = 0x10 | np.arange(counter, counter + n) & 15
        out[0, 1] |= 0x40
        out[0, 3] |= 0x20
        stuffing = 176 - len(first)
        out[0, 4], out[0, 5] = 7 + stuffing, 0x10 if i % ACCESS_EVERY else 0x50
        out[0, 6:12] = np.frombuffer(clock, np.uint8)
        out[0, 12 + stuffing :] = np.frombuffer(first, np.uint8)
        if full:
            out[1 : 1 + full, 4:] = np.frombuffer(rest, np.uint8, full * 184).reshape(full, 184)
        if tail:
            room = 183 - tail
            out[-1, 3] |= 0x20
            out[-1, 4] = room
            if room:
                out[-1, 5] = 0
            out[-1, PACKET - tail :] = np.frombuffer(rest[full * 184 :], np.uint8)
        counter = (counter + n) & 15
        parts.append(out.tobytes())
    return b"".join(parts)


def _layout(media: bytes) -> np.ndarray:
    """The transport packets, of streams of 188, 192 (with a time code before) or 204 bytes (with parity after) each."""
    for stride, before in ((PACKET, 0), (192, 4), (204, 0)):
        if media and len(media) % stride == 0:
            p = np.frombuffer(media, np.uint8).reshape(-1, stride)[:, before : before + PACKET]
            if (p[:, 0] == 0x47).all():
                return p
    raise ValueError("not a whole number of transport packets, or lost synchronisation")


class _Packets:
    """The packets of one identifier that carry data, without legal repetitions.

    ``payload`` holds each one's data, ``begins`` its unit-start flag, ``flagged`` its random-access
    indicator, ``broken`` whether packets are missing just before it or it is marked as damaged.
    """

    def __init__(self, p: np.ndarray) -> None:
        has_adaptation, has_data = p[:, 3] & 0x20 > 0, p[:, 3] & 0x10 > 0
        flags = np.where(has_adaptation & (p[:, 4] > 0), p[:, 5], 0)
        start = np.where(has_adaptation, 5 + p[:, 4].astype(np.int64), 4)
        self.payload: list[bytes] = []
        self.begins: list[bool] = []
        self.flagged: list[bool] = []
        self.broken: list[bool] = []
        self.errors = 0
        counter, again, reset = None, False, False
        rows = zip(p[:, 3] & 15, p[:, 1] & 0x40 > 0, p[:, 1] & 0x80 > 0, flags & 0x80 > 0, flags & 0x40 > 0, has_data, start, range(len(p)), strict=True)
        for now, begins, damaged, jump, flagged, data, at, i in rows:
            reset |= bool(jump)
            if not data:
                continue
            body = p[i, at:].tobytes()
            if counter is not None and now == counter and not reset and not again and not damaged and body == self.payload[-1]:
                again = True  # one repetition of a packet is legal
                continue
            gap = counter is not None and not reset and now != (counter + 1) & 15
            self.errors += gap
            self.payload.append(body)
            self.begins.append(bool(begins))
            self.flagged.append(bool(flagged))
            self.broken.append(bool(gap or damaged or at > PACKET))
            counter, again, reset = int(now), False, False


def _section_of(packets: _Packets, table_id: int) -> bytes:
    """The body of the first whole section of a table, which may span packets."""
    data = None
    for i, body in enumerate(packets.payload):
        if packets.broken[i]:
            data = None
        if packets.begins[i] and body:
            data = None if data is None else data + body[1 : 1 + body[0]]
            done = _whole_section(data, table_id)
            if done is not None:
                return done
            data = body[1 + body[0] :]
        elif data is not None:
            data += body
        while data and data[0] != 0xFF and len(data) >= 3 and len(data) >= (size := 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)):
            if (done := _whole_section(data, table_id)) is not None:
                return done
            data = data[size:]  # another table
    raise ValueError(f"no whole table {table_id}")


def _whole_section(data: bytes | None, table_id: int) -> bytes | None:
    if not data or data[0] != table_id or len(data) < 3:
        return None
    section = data[: 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)]
    if len(section) < 12 or len(section) < 3 + (int.from_bytes(data[1:3], "big") & 0xFFF):
        return None
    if crc32_mpeg(section) != 0:
        raise ValueError("a program table fails its CRC")
    return section[8:-4]


def _pts(unit: bytes) -> int | None:
    if len(unit) < 14 or not unit[7] & 0x80:
        return None
    t = unit[9:14]
    return (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1


def demux(media: bytes) -> dict:
    """payload, units (pts, offset, length, random_access, damaged), packets, streams, continuity_errors.

    Null packets are skipped, one repetition of a packet is dropped, a discontinuity that is
    announced is no error, tables may span packets, and what comes before the first unit is left
    out. A unit that has lost packets, or whose length or start code is wrong, is kept as far as it
    came and flagged as damaged.
    """
    p = _layout(media)
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    of = {int(one): _Packets(p[pid == one]) for one in np.unique(pid) if one != NULL_PID}
    if 0 not in of:
        raise ValueError("no program association table")
    pat = _section_of(of[0], 0)
    programs = [(int.from_bytes(pat[i : i + 2], "big"), int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF) for i in range(0, len(pat) - 3, 4)]
    at_pid = next((x for n, x in programs if n), None)
    if at_pid not in of:
        raise ValueError("no program map table")
    pmt = _section_of(of[at_pid], 2)
    at, streams = 4 + (int.from_bytes(pmt[2:4], "big") & 0xFFF), []
    while at + 5 <= len(pmt):
        streams.append((pmt[at], int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF))
        at += 5 + (int.from_bytes(pmt[at + 3 : at + 5], "big") & 0xFFF)
    if not streams:
        raise ValueError("a program without streams")
    units, parts, offset = [], [], 0
    own = of.get(streams[0][1])
    starts = [i for i, b in enumerate(own.begins) if b] if own else []
    for a, b in zip(starts, [*starts[1:], len(own.payload) if own else 0], strict=True):
        unit = b"".join(own.payload[a:b])
        good = unit[:3] == b"\x00\x00\x01" and len(unit) >= 9
        length = int.from_bytes(unit[4:6], "big")
        body = unit[9 + unit[8] : 6 + length if length else None] if good else b""
        lost = any(own.broken[a + 1 : b]) or (b < len(own.payload) and own.broken[b])
        damaged = not good or lost or (length > 0 and len(unit) < 6 + length)
        units.append({"pts": _pts(unit) if good else None, "offset": offset, "length": len(body), "random_access": own.flagged[a], "damaged": bool(damaged)})
        parts.append(body)
        offset += len(body)
    return {"payload": b"".join(parts), "units": units, "packets": len(p), "streams": len(streams), "continuity_errors": sum(x.errors for x in of.values())}


def payload_of(text: bytes | None) -> bytes:
    """The text's bytes with zeros up to a positive multiple of 64."""
    data = text or b""
    return data.ljust(max(PAD, -(-len(data) // PAD) * PAD), b"\x00")


def encode(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes and ``media``: each text as a transport stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for i in range(0, len(texts), 256):
                part = texts[i : i + 256]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(part)), pa.array([len(x or b"") for x in part], pa.int64()), pa.array([mux(payload_of(x)) for x in part], pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode(df: DataFrame, media: str = "media", with_payload: bool = True) -> DataFrame:
    """``df`` with what its media column holds: payload and units, and their digests.

    Without ``with_payload`` the payload itself is left out, and the digests stay.
    """
    fields = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("packets", pa.int64()), ("continuity_errors", pa.int64()), ("units", pa.list_(UNITS)), ("error", pa.string())]
    ddl = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, packets long, continuity_errors long, units array<struct<pts:long,offset:long,length:long,random_access:boolean,damaged:boolean>>, error string"
    if with_payload:
        fields, ddl = [("payload", pa.binary()), *fields], "payload binary, " + ddl
    keep = [c for c in df.columns if c != media]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != media)

    def one(data: bytes | None) -> dict:
        if data is None:
            return {"error": "null"}
        out = {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
        try:
            got = demux(data)
        except (ValueError, IndexError) as why:
            return out | {"error": str(why) or type(why).__name__}
        body = got["payload"]
        return out | {"payload": body, "payload_bytes": len(body), "payload_sha256": hashlib.sha256(body).hexdigest(), "tail_crc32": zlib.crc32(body[-PAD:]), "packets": got["packets"], "continuity_errors": got["continuity_errors"], "units": got["units"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(x.as_py()) for x in batch.column(batch.schema.get_field_index(media))]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array([x.get(n) for x in found], t) for n, t in fields]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *(n for n, _ in fields)])

    return df.mapInArrow(run, f"{head}, {ddl}" if head else ddl)


def op2_media_transport_stream(spark, sf_dir: str) -> DataFrame:
    media = stored(encode(table(spark, sf_dir, "documents")), "media")
    units = F.col("units")
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("packets="), F.col("packets")),
        F.concat(F.lit("continuity_errors="), F.col("continuity_errors")),
        F.concat(F.lit("units="), F.size(units)),
        F.concat(F.lit("random_access="), F.size(F.filter(units, lambda u: u.random_access))),
        F.concat(F.lit("damaged="), F.size(F.filter(units, lambda u: u.damaged))),
        F.concat(F.lit("pts="), F.array_min(units.pts), F.lit("-"), F.array_max(units.pts)),
    )
    return decode(media, with_payload=False).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "units")
