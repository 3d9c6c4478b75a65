"""MPEG transport streams as a media column: write payloads as streams, parse and check streams.

A stream is a run of 188-byte packets: a program association table, a program
map table, then the payload as packetized elementary stream (PES) packets with
a presentation time each. Access units of whole frames start at random-access
points that carry the program clock. The parser follows the tables, checks
continuity counters and section checksums, reassembles PES packets and records
timestamps with the random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACKET, SYNC = 188, 0x47
PROGRAM, PMT_PID, DATA_PID, NULL_PID = 1, 0x1000, 0x0100, 0x1FFF
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data in PES packets
FRAME = 192
UNIT = 46 * FRAME  # payload bytes of an access unit; one in RAP_EVERY is a random-access point
RAP_EVERY = 4
CLOCK = 90_000
STEP = 3600  # 25 units a second


def _crc_table() -> list[int]:
    out = []
    for k in range(256):
        c = k << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, program: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + program.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _section_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


_TABLES = _section_packet(0, _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _section_packet(
    PMT_PID,
    _section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"),
)


def _pts(t: int) -> bytes:
    return bytes([0x21 | (t >> 29) & 0x0E, (t >> 22) & 0xFF, 1 | (t >> 14) & 0xFE, (t >> 7) & 0xFF, 1 | (t << 1) & 0xFE])


def _read_pts(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def _field(flags: int, clock: int | None, length: int) -> bytes:
    """An adaptation field of ``length`` bytes in all, its length byte included."""
    if length == 1:
        return b"\x00"
    body = bytes([flags | 0x10 * (clock is not None)])
    if clock is not None:
        body += (clock << 15 | 0x7E00).to_bytes(6, "big")
    return bytes([length - 1]) + body.ljust(length - 1, b"\xff")


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream of one program with one data stream."""
    out, counter = [_TABLES], 0
    start, go_on = (0x4000 | DATA_PID).to_bytes(2, "big"), DATA_PID.to_bytes(2, "big")
    sync = bytes([SYNC])
    plain = [sync + go_on + bytes([0x10 | c]) for c in range(16)]
    for k in range(0, len(payload), UNIT):
        n = k // UNIT
        t = n * STEP % (1 << 33)
        unit = payload[k : k + UNIT]
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts(t) + unit
        rap = n % RAP_EVERY == 0
        least = 8 if rap else 0
        take = min(len(pes), 184 - least)
        if take < 184:
            out.append(sync + start + bytes([0x30 | counter]) + _field(0x40 * rap, t if rap else None, 184 - take) + pes[:take])
        else:
            out.append(sync + start + bytes([0x10 | counter]) + pes[:take])
        counter = (counter + 1) % 16
        while len(pes) - take >= 184:
            out.append(plain[counter] + pes[take : take + 184])
            take += 184
            counter = (counter + 1) % 16
        if take < len(pes):
            rest = pes[take:]
            out.append(sync + go_on + bytes([0x30 | counter]) + _field(0, None, 184 - len(rest)) + rest)
            counter = (counter + 1) % 16
    return b"".join(out)


@dataclass
class Elementary:
    """One elementary stream: its PES payloads, and per PES packet (time or None, byte offset in the data, random access)."""

    pid: int
    stream_type: int
    data: bytes = b""
    units: list[tuple[int | None, int, bool]] = field(default_factory=list)


@dataclass
class Stream:
    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, Elementary] = field(default_factory=dict)
    clocks: list[tuple[int, int]] = field(default_factory=list)  # (packet, program clock base)
    continuity_errors: int = 0
    duplicates: int = 0
    bad_sections: int = 0
    bad_packets: int = 0
    bad_units: int = 0


def _entries(section: bytes, out: Stream, pids: set[int]) -> None:
    size = int.from_bytes(section[1:3], "big") & 0xFFF
    section = section[: 3 + size]
    if size < 9 or len(section) < 3 + size or crc32_mpeg(section):
        out.bad_sections += 1
    elif section[0] == 0x00:
        for k in range(8, len(section) - 4, 4):
            program, pid = int.from_bytes(section[k : k + 2], "big"), int.from_bytes(section[k + 2 : k + 4], "big") & 0x1FFF
            if program:
                out.programs[program] = pid
                pids.add(pid)
    elif section[0] == 0x02:
        k = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
        while k + 5 <= len(section) - 4:
            pid = int.from_bytes(section[k + 1 : k + 3], "big") & 0x1FFF
            out.streams.setdefault(pid, Elementary(pid, section[k]))
            k += 5 + (int.from_bytes(section[k + 3 : k + 5], "big") & 0xFFF)


def demux(media: bytes) -> Stream:
    """Parses a stream. Packets that don't start in sync or end early count as bad and are passed over; a packet that repeats
    its predecessor's counter and bytes is a duplicate; other jumps of a counter are continuity errors unless announced."""
    out, tables, last = Stream(), {0}, {}
    sections: dict[int, bytearray] = {}
    open_units: dict[int, tuple[list[bytes], bool]] = {}
    parts: dict[int, list[bytes]] = {}
    sizes: dict[int, int] = {}

    def close(pid: int) -> None:
        chunks, rap = open_units.pop(pid)
        pes = b"".join(chunks)
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
            out.bad_units += 1
            return
        size, head = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
        time = _read_pts(pes[9:14]) if pes[7] & 0x80 and len(pes) >= 14 else None
        body = pes[head : 6 + size] if size else pes[head:]
        out.bad_units += bool(size and len(pes) < 6 + size)
        out.streams[pid].units.append((time, sizes.get(pid, 0), rap))
        parts.setdefault(pid, []).append(body)
        sizes[pid] = sizes.get(pid, 0) + len(body)

    for at in range(0, len(media), PACKET):
        p = media[at : at + PACKET]
        out.packets += 1
        if len(p) < PACKET or p[0] != SYNC or p[1] & 0x80:
            out.bad_packets += 1
            continue
        pid, flags = (p[1] & 0x1F) << 8 | p[2], p[3]
        if pid == NULL_PID:
            continue
        begin, rap, jump = 4, False, False
        if flags & 0x20:
            size = p[4]
            begin = 5 + size
            if size:
                jump, rap = bool(p[5] & 0x80), bool(p[5] & 0x40)
                if p[5] & 0x10 and size >= 7:
                    out.clocks.append((at // PACKET, int.from_bytes(p[6:12], "big") >> 15))
        if not flags & 0x10 or begin > PACKET:
            continue
        before = last.get(pid)
        if before is not None and not jump:
            if before[0] == flags & 15 and before[1] == p:
                out.duplicates += 1
                continue
            out.continuity_errors += (before[0] + 1) % 16 != flags & 15
        last[pid] = (flags & 15, p)
        if pid in tables:
            if p[1] & 0x40:
                sections[pid] = bytearray(p[begin + 1 + p[begin] :])
            elif pid in sections:
                sections[pid] += p[begin:]
            held = sections.get(pid)
            if held and len(held) >= 3 and len(held) >= 3 + (int.from_bytes(held[1:3], "big") & 0xFFF):
                _entries(bytes(sections.pop(pid)), out, tables)
        elif pid in out.streams:
            if p[1] & 0x40:
                if pid in open_units:
                    close(pid)
                open_units[pid] = ([p[begin:]], rap)
            elif pid in open_units:
                open_units[pid][0].append(p[begin:])
    for pid in list(open_units):
        close(pid)
    for pid, found in parts.items():
        out.streams[pid].data = b"".join(found)
    return out


def framed(raw: bytes) -> bytes:
    """``raw`` with spaces appended up to a positive multiple of a frame."""
    return raw.ljust(max(FRAME, -(-len(raw) // FRAME) * FRAME), b" ")


def features(stream: Stream) -> str:
    """What the stream's structure says, as ``name=value`` pairs."""
    own = next(iter(stream.streams.values()), None)
    units = own.units if own else []
    raps = [(t, at) for t, at, rap in units if rap]
    times = [t for t, _, _ in units if t is not None]
    data = own.data if own else b""
    pairs = {
        "packets": stream.packets, "programs": len(stream.programs), "pid": own.pid if own else -1, "type": own.stream_type if own else -1,
        "units": len(units), "rap": len(raps), "first_pts": times[0] if times else -1, "last_pts": times[-1] if times else -1,
        "clocks": len(stream.clocks), "cc_errors": stream.continuity_errors, "errors": stream.bad_sections + stream.bad_packets + stream.bad_units,
        "adler": zlib.adler32(data),
    }
    return ";".join(f"{k}={v}" for k, v in pairs.items())


SCHEMA = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "access_points array<struct<pts: long, offset: long>>, media binary"
)


def store(df: DataFrame, key: str, data: Column, keep_media: bool = True) -> DataFrame:
    """A row per row of ``df``: its key, the stream of ``data`` (binary or text; null: empty), and what reading it back gives.

    The payload columns come from the parsed stream, not from what was written. Map only; rows repeat as they do in ``df``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                rows = []
                for raw in part.column(1).to_pylist():
                    raw = raw or b""
                    media = mux(framed(raw))
                    back = demux(media)
                    own = back.streams[DATA_PID]
                    rows.append({
                        "n_bytes": len(raw), "payload_bytes": len(own.data), "payload_sha256": hashlib.sha256(own.data).hexdigest(),
                        "tail_crc32": zlib.crc32(own.data[-16:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
                        "feature": features(back), "access_points": [{"pts": t, "offset": at} for t, at, rap in own.units if rap],
                        "media": media if keep_media else None,
                    })
                made = pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                yield pa.RecordBatch.from_arrays([part.column(0), *made.columns], ["__key", *_ARROW.names])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`").alias("__key"), data.cast("binary").alias("__data"))
    return rows.mapInArrow(run, f"__key {kind}, {SCHEMA}").withColumnRenamed("__key", key)


_ARROW = pa.schema([
    ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
    ("access_points", pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64())]))), ("media", pa.binary()),
])
