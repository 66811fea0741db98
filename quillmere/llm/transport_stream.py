"""Media columns: MPEG transport streams written, parsed and measured.

``write_stream`` stores 8-bit samples as one program: a program association and
a program map packet, then elementary packets with a presentation time each, cut
into 188-byte packets with continuity counters. Every elementary packet starts a
packet with the random-access flag and a clock reference.

``read_stream`` parses any stream of whole packets: it follows the
association table to the first program's map table and on to its first elementary stream, reassembles sections over
packets and checks their checksums, checks continuity counters, reassembles elementary packets by their start
flags and lists their times, sizes and random-access points. Repeated packets are read once, flagged discontinuities are
no errors, elementary packets without a length end where the next one starts. Lost packets are counted, as breaks of the counter and as
``damaged`` elementary packets, of which what arrived is kept. It does not rely on how the writer laid packets out.

A null or empty text is a payload of 192 spaces. Repeated texts give equal
values. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillmere.llm.batches import append_columns, raw_bytes

PACKET, UNIT = 188, 192
SAMPLES_A_SECOND = 48_000
CLOCK = 90_000
#: Samples of one elementary packet.
AU_SAMPLES = 48 * UNIT
PAT_PID, PMT_PID, AUDIO_PID = 0, 0x100, 0x101
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data in elementary packets


@lru_cache(maxsize=None)
def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


@lru_cache(maxsize=1024)
def section_crc(data: bytes) -> int:
    """Checksum of table sections; 0 over a section with its own checksum."""
    c, table = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ table[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    body = b"\0" + section
    return bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10]) + body + b"\xff" * (PACKET - 4 - len(body))


@lru_cache(maxsize=None)
def _tables() -> np.ndarray:
    pat = _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
    pmt = _section(2, 1, bytes([0xE0 | AUDIO_PID >> 8, AUDIO_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | AUDIO_PID >> 8, AUDIO_PID & 255, 0xF0, 0]))
    return np.frombuffer(_table_packet(PAT_PID, pat) + _table_packet(PMT_PID, pmt), np.uint8).reshape(2, PACKET)


def _time_bytes(t: np.ndarray) -> np.ndarray:
    """33-bit times as the five bytes of an elementary packet's header."""
    return np.stack([0x21 | (t >> 30 & 7) << 1, t >> 22 & 255, 1 | (t >> 15 & 127) << 1, t >> 7 & 255, 1 | (t & 127) << 1], 1).astype(np.uint8)


def write_stream(samples: np.ndarray) -> np.ndarray:
    """A transport stream of uint8 samples."""
    n = len(samples)
    starts = np.arange(0, n, AU_SAMPLES)
    sizes = np.minimum(AU_SAMPLES, n - starts)
    pts = starts * CLOCK // SAMPLES_A_SECOND
    heads = np.zeros((len(starts), 14), np.uint8)
    heads[:, 2] = 1
    heads[:, 3] = STREAM_ID
    heads[:, 4], heads[:, 5] = (sizes + 8) >> 8, (sizes + 8) & 255
    heads[:, 6], heads[:, 7], heads[:, 8] = 0x84, 0x80, 5
    heads[:, 9:] = _time_bytes(pts)
    # elementary packets end to end
    pes = np.empty(n + 14 * len(starts), np.uint8)
    for k, (a, s) in enumerate(zip(starts.tolist(), sizes.tolist())):
        b = a + 14 * k
        pes[b : b + 14] = heads[k]
        pes[b + 14 : b + 14 + s] = samples[a : a + s]
    # a first packet has 8 bytes of adaptation, others none but what fills the last
    total = sizes + 14
    more = -(-np.maximum(total - 176, 0) // 184)
    count = 1 + more
    first = np.cumsum(count) - count
    packets = np.full((int(count.sum()), PACKET), 0xFF, np.uint8)
    begin = np.full(len(packets), 4)
    begin[first] = 12
    last = first + more
    room = np.where(more > 0, 176 + 184 * more, 176)
    begin[last] += room - total
    packets[:, 0] = 0x47
    packets[:, 1], packets[:, 2] = AUDIO_PID >> 8, AUDIO_PID & 255
    packets[first, 1] |= 0x40
    packets[:, 3] = np.arange(len(packets)) & 15 | np.where(begin > 4, 0x30, 0x10)
    adapted = np.flatnonzero(begin > 4)
    packets[adapted, 4] = begin[adapted] - 5
    long = adapted[begin[adapted] > 5]
    packets[long, 5] = 0
    packets[first, 5] = 0x50
    packets[first, 6:10] = (pts >> 1).astype(">u4").view(np.uint8).reshape(-1, 4)
    packets[first, 10], packets[first, 11] = (pts & 1) << 7 | 0x7E, 0
    packets[np.arange(PACKET) >= begin[:, None]] = pes
    return np.concatenate([_tables(), packets]).reshape(-1)


@dataclass
class Stream:
    """What reading a stream gives."""

    payload: np.ndarray
    program: int
    map_pid: int
    audio_pid: int
    stream_type: int
    continuity_errors: int
    damaged: int  # elementary packets that are not as long as they say
    pts: np.ndarray  # -1 where there is none
    sizes: np.ndarray
    access_points: np.ndarray  # packet numbers


def _sections(packets: np.ndarray, begin: np.ndarray, start: np.ndarray):
    """Whole sections with right checksums, from packets of one table, in order; and whether any was wrong."""
    for k in np.flatnonzero(start).tolist():
        raw = packets[k, begin[k] :].tobytes()
        raw = raw[1 + raw[0] :] if raw else raw
        following = k + 1
        while len(raw) < 3 or raw[0] != 0xFF and len(raw) < 3 + ((raw[1] & 15) << 8 | raw[2]):
            if following == len(packets) or start[following]:
                break
            raw += packets[following, begin[following] :].tobytes()
            following += 1
        size = 3 + ((raw[1] & 15) << 8 | raw[2]) if len(raw) > 2 else 3
        if len(raw) >= size and raw[0] != 0xFF and size > 3 and not section_crc(raw[:size]):
            yield raw[:size]


def read_stream(media: np.ndarray) -> Stream:
    """Parses a stream; broken sync bytes, tables that are missing or wrong, or no elementary packet at all raise ValueError."""
    if len(media) % PACKET:
        raise ValueError("no whole number of packets")
    p = media.reshape(-1, PACKET)
    if len(p) == 0 or (p[:, 0] != 0x47).any():
        raise ValueError("a sync byte is missing")
    pid = (p[:, 1].astype(np.int32) & 31) << 8 | p[:, 2]
    control = p[:, 3] >> 4 & 3
    begin = np.where(control & 2, 5 + p[:, 4].astype(np.int32), 4)
    begin[(control & 1) == 0] = PACKET
    start = (p[:, 1] & 0x40) > 0

    def table(of: int, kind: int) -> bytes:
        mine = pid == of
        found = next((s for s in _sections(p[mine], begin[mine], start[mine]) if s[0] == kind), None)
        if found is None:
            raise ValueError("a table is missing or its checksum is wrong")
        return found

    pat = table(PAT_PID, 0)
    program, map_pid = next((n, m) for n, m in ((pat[k] << 8 | pat[k + 1], (pat[k + 2] & 31) << 8 | pat[k + 3]) for k in range(8, len(pat) - 4, 4)) if n)
    pmt = table(map_pid, 2)
    at = 12 + ((pmt[10] & 15) << 8 | pmt[11])
    kind, audio = pmt[at], (pmt[at + 1] & 31) << 8 | pmt[at + 2]
    number = np.flatnonzero(pid == audio)
    counter, carries = p[number, 3] & 15, (p[number, 3] & 0x10) > 0
    twin = np.flatnonzero((counter[1:] == counter[:-1]) & carries[1:] & carries[:-1]) + 1
    twin = twin[(p[number[twin]] == p[number[twin - 1]]).all(1)]
    if len(twin):
        number, counter, carries = (np.delete(x, twin) for x in (number, counter, carries))
    q, begin, start = p[number], begin[number], start[number]
    flags = np.where((q[:, 3] & 0x20 > 0) & (q[:, 4] > 0), q[:, 5], 0)
    jump = (counter[1:] - counter[:-1] - carries[1:]) & 15
    errors = int(((jump != 0) & (flags[1:] & 0x80 == 0)).sum())
    pes = q[np.arange(PACKET) >= begin[:, None]]
    held = PACKET - begin
    heads = (np.cumsum(held) - held)[start]
    ends = np.append(heads[1:], len(pes))
    whole = ends - heads >= 9
    if not whole.any() or (pes[heads[whole]] | pes[heads[whole] + 1]).any() or (pes[heads[whole] + 2] != 1).any():
        raise ValueError("an elementary packet has no start code")
    damaged = int((~whole).sum())
    heads, ends = heads[whole], ends[whole]
    skip = 9 + pes[heads + 8].astype(np.int64)
    said = pes[heads + 4].astype(np.int64) << 8 | pes[heads + 5]
    there = np.maximum(ends - heads - skip, 0)
    sizes = np.where(said > 0, np.minimum(there, np.maximum(6 + said - skip, 0)), there)
    damaged += int(((said > 0) & (there != 6 + said - skip)).sum())
    timed = (pes[heads + 7] & 0x80 > 0) & (ends - heads >= 14)
    t = pes[np.minimum(heads[:, None] + np.arange(9, 14), len(pes) - 1)].astype(np.int64)
    pts = np.where(timed, (t[:, 0] >> 1 & 7) << 30 | t[:, 1] << 22 | t[:, 2] >> 1 << 15 | t[:, 3] << 7 | t[:, 4] >> 1, -1)
    payload = np.concatenate([pes[a : a + n] for a, n in zip((heads + skip).tolist(), sizes.tolist())])
    return Stream(payload, program, map_pid, audio, kind, errors, damaged, pts, sizes, number[(flags & 0x40 > 0) & start])


def feature(s: Stream) -> str:
    """Whole numbers from what was read: packets, times, level, sign changes about the mid level."""
    x = s.payload.astype(np.int32) - 128
    turns = int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
    return (
        f"units={len(s.pts)};access={len(s.access_points)};lost={s.continuity_errors};last_pts={int(s.pts[-1])};"
        f"mean={int(x.sum()) * 1000 // len(x)};power={int((x * x).sum(dtype=np.int64)) // len(x)};turns={turns}"
    )


def pad(text: bytes) -> bytes:
    """Spaces up to a positive multiple of UNIT bytes."""
    return text + b" " * (UNIT - len(text) if len(text) < UNIT else -len(text) % UNIT)


def media_columns(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, with_media: bool = False) -> DataFrame:
    """Kept columns with the digest of each text's stored stream.

    ``pts`` (one time an elementary packet) and ``access_points`` (packet numbers)
    are stored beside it, and with ``with_media`` the stream itself.
    """
    fields = [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("continuity_errors", T.IntegerType()),
        T.StructField("pts", T.ArrayType(T.LongType())),
        T.StructField("access_points", T.ArrayType(T.LongType())),
        *([T.StructField("media", T.BinaryType())] if with_media else []),
    ]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def make():
        def run(array: pa.Array):
            data, at = raw_bytes(array)
            rows = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                samples = np.frombuffer(pad(data[a:b].tobytes()), np.uint8)
                media = write_stream(samples)
                s = read_stream(media)
                stored = media.tobytes()
                row = (
                    b - a, len(s.payload), hashlib.sha256(s.payload.tobytes()).hexdigest(), zlib.crc32(s.payload[-16:].tobytes()),
                    len(stored), hashlib.sha256(stored).hexdigest(), feature(s), s.continuity_errors, s.pts.tolist(), s.access_points.tolist(), stored,
                )
                rows.append(row[: len(fields)])
            cols = list(zip(*rows)) if rows else [()] * len(fields)
            return [pa.array(c, k) for c, k in zip(cols, kinds)]

        return run

    return append_columns(docs, text_col, make, fields, keep)
