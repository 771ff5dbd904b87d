"""Media columns of MPEG transport streams.

A binary column is carried as an elementary stream: packetised (PES) with a time stamp per unit,
multiplexed into 188-byte packets behind a program association and a program map table, with
continuity counters, and clock references at random-access points. The parser finds the stream by
the tables, checks the counters, and reassembles the units with their stamps.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

# Fixed values of the format.
PACKET, SYNC, PAT_PID, PRIVATE_DATA, PRIVATE_STREAM, CLOCK = 188, 0x47, 0, 0x06, 0xBD, 90_000
PMT_PID, STREAM_PID, PROGRAM = 0x100, 0x101, 1
#: Bytes of a unit, ticks between units, and every how many units is a random-access point.
UNIT, TICKS, ACCESS_EVERY = 8192, 3003, 4
ALIGN = 64


def _crc_table() -> list[int]:
    out = []
    for k in range(256):
        c = k << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", section_crc(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10, 0) + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(PAT_PID, _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))) + _table_packet(PMT_PID, _section(2, PROGRAM, struct.pack(">HH", 0xE000 | STREAM_PID, 0xF000) + struct.pack(">BHH", PRIVATE_DATA, 0xE000 | STREAM_PID, 0xF000)))


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def multiplex(payload: bytes, unit: int = UNIT) -> bytes:
    """A transport stream that holds the payload."""
    out, counter = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), unit)):
        body, pts = payload[at : at + unit], k * TICKS & (1 << 33) - 1
        pes = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, len(body) + 8, 0x84, 0x80, 5) + _stamp(pts) + body
        access = k % ACCESS_EVERY == 0
        first = struct.pack(">BBIH", 7, 0x50, pts >> 1, (pts & 1) << 15 | 0x7E00) if access else b""
        room = PACKET - 4 - len(first)
        if len(pes) < room:  # the only packet of the unit: stuff it
            first, room = _stuffed(first, room - len(pes)), len(pes)
        rest = len(pes) - room
        n = 1 + -(-rest // (PACKET - 4))
        packets = np.empty((n, PACKET), np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        if first:
            packets[0, 3] |= 0x20
            packets[0, 4 : 4 + len(first)] = np.frombuffer(first, np.uint8)
        packets[0, PACKET - room :] = np.frombuffer(pes, np.uint8, room)
        full = rest // (PACKET - 4)
        if full:
            packets[1 : 1 + full, 4:] = np.frombuffer(pes, np.uint8, full * (PACKET - 4), room).reshape(full, -1)
        if tail := rest - full * (PACKET - 4):
            stuffing = _stuffed(b"", PACKET - 4 - tail)
            packets[-1, 3] |= 0x20
            packets[-1, 4 : 4 + len(stuffing)] = np.frombuffer(stuffing, np.uint8)
            packets[-1, PACKET - tail :] = np.frombuffer(pes, np.uint8, tail, len(pes) - tail)
        out.append(packets.tobytes())
    return b"".join(out)


def _stuffed(field_: bytes, more: int) -> bytes:
    """An adaptation field that is `more` bytes longer."""
    if field_:
        return bytes([field_[0] + more]) + field_[1:] + b"\xff" * more
    return b"\x00" if more == 1 else bytes([more - 1, 0]) + b"\xff" * (more - 2)


@dataclass
class Stream:
    """A parsed stream: units (time stamp, whether random access starts there, first byte, size) and faults."""

    payload: bytes = b""
    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    stream_type: int | None = None
    units: list[tuple[int, bool, int, int]] = field(default_factory=list)
    discontinuities: int = 0
    bad_sections: int = 0
    lost_bytes: int = 0


def _tables(packet: bytes, out: Stream) -> bytes | None:
    """The section of a packet that begins one, if its checksum is right."""
    at = 4 + (1 + packet[4] if packet[3] & 0x20 else 0)
    at += 1 + packet[at]
    size = 3 + (struct.unpack_from(">H", packet, at + 1)[0] & 0xFFF)
    section = packet[at : at + size]
    if len(section) != size or section_crc(section):
        out.bad_sections += 1
        return None
    return section


def _aligned(media: bytes) -> tuple[np.ndarray, int]:
    """The packets of a stream and how many bytes belong to none.

    Where a packet doesn't begin with the sync byte, reading goes on at the next sync byte that a
    packet's length later has another one, or the end.
    """
    data = np.frombuffer(media, np.uint8)
    whole = data[: len(data) // PACKET * PACKET].reshape(-1, PACKET)
    if (whole[:, 0] == SYNC).all():
        return whole, len(data) % PACKET
    parts, at, lost = [], 0, 0
    while len(data) - at >= PACKET:
        rest = data[at : at + (len(data) - at) // PACKET * PACKET].reshape(-1, PACKET)
        bad = np.flatnonzero(rest[:, 0] != SYNC)
        good = int(bad[0]) if len(bad) else len(rest)
        parts.append(rest[:good])
        at += good * PACKET
        if not len(bad):
            break
        marks = at + np.flatnonzero(data[at:] == SYNC)
        follows = marks + PACKET
        ok = np.flatnonzero((follows == len(data)) | ((follows < len(data)) & (data[np.minimum(follows, len(data) - 1)] == SYNC)))
        if not len(ok):
            break
        lost += int(marks[ok[0]]) - at
        at = int(marks[ok[0]])
    return np.concatenate(parts) if parts else whole[:0], lost + len(data) - at


def parse(media: bytes) -> Stream:
    """Reads a transport stream.

    Bytes of no whole packet count as lost. A packet that repeats the one before it is legal once
    and counts once; a counter may jump where a packet says so.
    """
    p, lost = _aligned(media)
    out = Stream(packets=len(p), lost_bytes=lost)
    pid = (p[:, 1].astype(np.int64) & 0x1F) << 8 | p[:, 2]
    starts = (p[:, 1] & 0x40) > 0
    for k in np.flatnonzero((pid == PAT_PID) & starts).tolist():
        if section := _tables(p[k].tobytes(), out):
            for at in range(8, len(section) - 4, 4):
                number, where = struct.unpack_from(">HH", section, at)
                if number:
                    out.programs[number] = where & 0x1FFF
    elementary = None
    for where in dict.fromkeys(out.programs.values()):
        for k in np.flatnonzero((pid == where) & starts).tolist():
            if section := _tables(p[k].tobytes(), out):
                at = 12 + (struct.unpack_from(">H", section, 10)[0] & 0xFFF)
                while at < len(section) - 4:
                    kind, stream, info = struct.unpack_from(">BHH", section, at)
                    if elementary is None:
                        elementary, out.stream_type = stream & 0x1FFF, kind
                    at += 5 + (info & 0xFFF)
    if elementary is None:
        return out
    p, starts = p[pid == elementary], starts[pid == elementary]
    has_field, has_payload = (p[:, 3] & 0x20) > 0, (p[:, 3] & 0x10) > 0
    carrying = np.flatnonzero(has_payload)
    again = np.zeros(len(p), bool)
    if len(carrying) > 1:
        again[carrying[1:]] = (p[carrying[1:]] == p[carrying[:-1]]).all(1)
        again[carrying[2:]] &= ~again[carrying[1:-1]]
    p, starts, has_field, has_payload = (x[~again] for x in (p, starts, has_field, has_payload))
    allowed = has_field & (p[:, 4] > 0) & ((p[:, 5] & 0x80) > 0)
    counter = p[:, 3].astype(np.int64) & 15
    with_payload = counter[has_payload]
    out.discontinuities = int((((np.diff(with_payload) - 1) % 16 != 0) & ~allowed[has_payload][1:]).sum())
    begin = 4 + np.where(has_field, 1 + p[:, 4].astype(np.int64), 0)
    access = has_field & (p[:, 4] > 0) & ((p[:, 5] & 0x40) > 0)
    begin = np.where(has_payload, np.minimum(begin, PACKET), PACKET)
    body = p[np.arange(PACKET) >= begin[:, None]].tobytes()
    ends = np.cumsum(PACKET - begin)
    first = np.flatnonzero(starts)
    at = (ends - (PACKET - begin))[first].tolist()
    parts, size = [], 0
    if first.size:
        out.lost_bytes += at[0]
    for a, b, k in zip(at, [*at[1:], len(body)], first.tolist(), strict=True):
        if b - a < 9 or body[a : a + 3] != b"\0\0\1":
            out.lost_bytes += b - a
            continue
        length = struct.unpack_from(">H", body, a + 4)[0]
        head = 9 + body[a + 8]
        pts = _read_stamp(body[a + 9 : a + 14]) if body[a + 7] & 0x80 else -1
        part = body[a + head : min(b, a + 6 + length) if length else b]
        out.units.append((pts, bool(access[k]), size, len(part)))
        parts.append(part)
        size += len(part)
    out.payload = b"".join(parts)
    return out


def padded(text: bytes) -> bytes:
    """The text and bytes 0, up to a positive multiple of ALIGN."""
    return text.ljust(max(ALIGN, -(-len(text) // ALIGN) * ALIGN), b"\0")


def describe(s: Stream) -> str:
    times = [u[0] for u in s.units]
    return f"packets={s.packets};type={s.stream_type};units={len(s.units)};access={sum(u[1] for u in s.units)};pts={min(times, default=-1)}-{max(times, default=-1)};discontinuities={s.discontinuities};bad_sections={s.bad_sections};lost={s.lost_bytes}"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            bodies = part.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, bodies)), pa.int64()), pa.array([multiplex(padded(b)) for b in bodies], pa.binary())], names=["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the transport stream of each text; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long"), common.text_or_empty().cast("binary").alias("body")).mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, n_bytes, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if media is None:
                rows.append((doc_id, n_bytes, None, None, None, None, None, None))
                continue
            s = parse(media)
            rows.append((doc_id, n_bytes, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), describe(s)))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[c.split()[0] for c in FEATURES.split(", ")])


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes of each row (doc_id, n_bytes, media) hold; null media give nulls."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, FEATURES)


UNITS = "doc_id long, unit int, pts long, seconds double, random_access boolean, first_byte long, size long"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64())
    for batch in batches:
        rows = [(doc_id, k, pts, pts / CLOCK, access, first, size) for doc_id, media in zip(*(c.to_pylist() for c in batch.columns), strict=True) if media is not None for k, (pts, access, first, size) in enumerate(parse(media).units)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[c.split()[0] for c in UNITS.split(", ")])


def units(media: DataFrame) -> DataFrame:
    """A row per unit of each stream: its time stamp, and whether decoding can start there."""
    return media.select("doc_id", "media").mapInArrow(_units, UNITS)


def document_features(docs: DataFrame) -> DataFrame:
    """Stores every text as a transport stream in the shared folder, reads it back, and describes what was read.

    A null text is stored as an empty one; repeated rows and null ids are rows like any other.
    """
    return features(common.written(store(docs), "media"))
